"""URL filter: explicit rules, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.llm import quality
from lexlake.storage import BROADCAST_ROWS, materialize

#: (verdict, host, path); the longest rule that fits decides.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Labelled rows that the trees are fitted to: about so many, chosen by a hash of the URL and the row's number.
TRAIN_ROWS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, with A-Z in lower case; empty for null or no ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def with_rules(urls: DataFrame, rules: tuple = RULES) -> DataFrame:
    """urls (host, path) with rule (host and path of the longest fitting rule, else null) and rule_verdict."""
    rule = verdict = F.lit(None).cast("string")
    for decision, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    bits = lambda c: -F.size(F.filter(chars, lambda d: d == c)) / n * F.log2(F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(n > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + bits(c))).otherwise(0.0)


#: Lexical features of a url with its host and path.
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "marks", "entropy", "parameters", "fragment", "secure", "suffix_share", "suffix_rate")


def with_features(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with all FEATURES but the suffix statistics, and suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    values = {
        "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": _count(F.col("path"), "/[^/]"), "labels": _count(F.col("host"), "[^.]+"), "digit_ratio": _count(url, "[0-9]") / n,
        "host_digit_ratio": _count(F.col("host"), "[0-9]") / F.greatest(F.length("host"), F.lit(1)), "hyphens": _count(F.col("host"), "-"), "marks": _count(url, "[^A-Za-z0-9]"),
        "entropy": _entropy(F.col("host")), "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1), "fragment": _count(url, "#"), "secure": F.lower(url).startswith("https:").cast("double"),
    }
    return urls.withColumns(values | {"suffix": F.regexp_extract("host", r"([^.]*)$", 1)})


def visible_text(html: Column) -> Column:
    """A page without its scripts, styles and tags."""
    return F.regexp_replace(F.coalesce(html.cast("string"), F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")


def label_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, label 0/1) of all pages. 1: unwanted, since the page's own text fails the quality rules. Null html has no text and fails."""
    judged = pages.select(F.col(url).cast("string").alias("url"), quality.counts_of(visible_text(F.col(html))).alias("counts")).select("url", "counts.*")
    return judged.select("url", quality.base_failed().cast("double").alias("label"))


class UrlTrees:
    """Boosted trees with the suffix statistics that their inputs need."""

    def __init__(self, labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = 15, depth: int = 4):
        """Count suffixes in all labelled URLs (url, label); fit to about rows of them. With one label only, that label is always given.

        A URL that is labelled several times counts and is drawn row by row, so however often it occurs, no more rows are
        drawn than of as many different ones.
        """
        numbered = labelled.withColumn("__row", F.monotonically_increasing_id())
        labelled = materialize(with_features(numbered.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))), "labelled-urls")
        n, bad = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        self.mean = bad / n if n else 0.0
        self.only = float(bad > 0) if bad in (0, n) else None
        rate = (F.sum("label") + 10 * self.mean) / (F.count(F.lit(1)) + 10)
        self.suffixes = materialize(labelled.groupBy("suffix").agg((F.count(F.lit(1)) / max(n, 1)).alias("suffix_share"), rate.alias("suffix_rate")), "url-suffixes")
        self.few = self.suffixes.count() <= BROADCAST_ROWS
        if self.only is None:
            drawn = F.pmod(F.xxhash64(F.coalesce(F.col("url"), F.lit("")), F.col("__row")), F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30))
            part = labelled.filter(drawn)
            part = self._vectors(labelled if part.isEmpty() else part).select("features", "label").coalesce(max(1, -(-min(n, rows) // 5_000))).persist()
            self.model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=7).fit(part)
            part.unpersist()

    def _vectors(self, urls: DataFrame) -> DataFrame:
        """urls with_features, with their feature vectors; an unknown suffix has no share and the mean rate."""
        known = urls.join(F.broadcast(self.suffixes) if self.few else self.suffixes, "suffix", "left")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known.fillna({"suffix_share": 0.0, "suffix_rate": self.mean}))

    def score(self, urls: DataFrame) -> DataFrame:
        """urls (url, host, path, ...) with score, the probability that one is unwanted."""
        if self.only is not None:
            return urls.withColumn("score", F.lit(self.only))
        own = urls.columns
        return self.model.transform(self._vectors(with_features(urls))).select(*own, vector_to_array("probability")[1].alias("score"))


def filter_urls(pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", rules: tuple = RULES, limit: float = 0.5) -> DataFrame:
    """Per row: key, host, path, rule, verdict (allow or block), score.

    The longest fitting rule decides; else the trees: block if the score is above limit. Null or odd URLs have an
    empty host and path and are judged by the trees. Rows repeat as they do in pages; other columns are not read.
    """
    rows = pages.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = with_rules(UrlTrees(labelled).score(rows), rules)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > limit, "block").otherwise("allow"))
    return judged.select(F.col("__key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score")
