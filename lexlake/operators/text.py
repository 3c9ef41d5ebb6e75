"""Text operators: cleaning, masking, measuring, hashing and extraction."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.storage import small_batches

#: Grams of all sources that fuzzy_matches sends to every task; more of them are joined.
GRAMS_SENT = 4_000_000
#: Characters that count as a token each: CJK punctuation, kana, ideographs with extension A, compatibility ideographs,
#: full-width forms. Fixed values.
CJK = r"\u3000-\u303F\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF00-\uFFEF"
#: Scripts whose runs are terms of their own.
SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
#: Words and codes of message types, in the order that they are tried in. Fixed values.
MESSAGE_TYPES = (
    ("voice", ("voice", "语音", "audio"), (34,)), ("video", ("video", "视频"), (43, 62)),
    ("image", ("image", "图片", "照片", "picture", "photo"), (3,)), ("text", ("text", "文本", "文字"), (1,)),
)
#: Identity card, bank card, mobile number, e-mail address, and what a text needs for any of the first three. Fixed values.
_ID_CARD = r"(?<!\d)(\d{6})\d{8}(\d{3}[\dXx])(?!\d)"
_BANK_CARD = r"(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?:[ -]?\d{1,3})?(?![\d-])"
_PHONE = r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_DIGITS = r"\d{4}[ -]?\d{4}[ -]?\d{3}"
#: Login pages: a password field; a login-like address; a login-like title. Fixed values.
_PASSWORD = r"(?i)<input[^>]{0,300}type\s*=\s*[\"']?password"
_LOGIN_URL = r"(?i)(^|[/.])(login|signin|sign-in|sso|cas|authorize)([/.?#]|$)"
_LOGIN_TITLE = r"(?i)<title[^>]*>[^<]*(log\s?in|sign\s?in|登录|登入)"
#: Longest line that can be a header or footer; lines looked at on each edge; least share of pages.
EDGE_CHARS, EDGE_LINES, EDGE_SHARE = 120, 2, 0.6
MASK = "*"


def token_estimate(text: Column) -> Column:
    """CJK characters, and a quarter of the others rounded up; characters beyond the first plane count twice (UTF-16 units)."""
    text = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    far = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return (cjk + F.ceil((F.char_length(text) + far - cjk) / 4)).cast("long")


def normal_line(line: Column) -> Column:
    """A line without digits, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"\d", ""), r"\s+", " "))


def page_edges(pages: DataFrame) -> DataFrame:
    """Normalised edge lines (doc_id, page_no, line) of pages (doc_id, page_no, text)."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    edges = pages.select("doc_id", "page_no", lines.alias("l"))
    both = F.when(F.size("l") > 0, F.concat(F.slice("l", 1, EDGE_LINES), F.slice("l", F.greatest(F.size("l") - EDGE_LINES + 1, F.lit(1)), F.lit(EDGE_LINES)))).otherwise(F.array().cast("array<string>"))
    out = edges.select("doc_id", "page_no", F.explode(F.array_distinct(both)).alias("raw")).filter(F.char_length("raw") <= EDGE_CHARS)
    return out.select("doc_id", "page_no", normal_line(F.col("raw")).alias("line")).filter("line <> ''")


def page_furniture(pages: DataFrame, share: float = EDGE_SHARE) -> DataFrame:
    """Headers and footers (doc_id, line): edge lines on that share of a document's pages, two at least."""
    total = pages.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    seen = page_edges(pages).groupBy("doc_id", "line").agg(F.countDistinct("page_no").alias("n"))
    return seen.join(total, "doc_id").filter((F.col("pages") >= 2) & (F.col("n") >= F.greatest(F.lit(2), F.ceil(share * F.col("pages"))))).select("doc_id", "line")


def remove_furniture(pages: DataFrame, share: float = EDGE_SHARE) -> DataFrame:
    """pages with the text's lines that are furniture taken out."""
    lines = page_furniture(pages, share).groupBy("doc_id").agg(F.collect_set("line").alias("__f"))
    kept = F.filter(F.split("text", "\n"), lambda x: F.coalesce(~F.array_contains("__f", normal_line(x)), F.lit(True)))
    return pages.join(lines, "doc_id", "left").withColumn("text", F.array_join(kept, "\n")).drop("__f")


def _each_match(text: Column, pattern: str, changed: Callable[[Column], Column]) -> Column:
    """text with what the pattern finds replaced by changed(match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), found, lambda rest, x: F.concat(rest, F.coalesce(changed(x), F.lit(""))))
    return F.array_join(parts, "")


def _masked_card(card: Column) -> Column:
    """All digits but the last four masked; grouping stays."""
    tail = F.regexp_extract(card, r"(\d[ -]?\d[ -]?\d[ -]?\d)$", 1)
    return F.concat(F.regexp_replace(F.substring(card, F.lit(1), F.char_length(card) - F.char_length(tail)), r"\d", MASK), tail)


def mask_email(text: Column) -> Column:
    """E-mail names masked but for their first letter (one letter: that too)."""
    name = lambda x: F.substring_index(x, "@", 1)
    stars = lambda x: F.concat(F.when(F.char_length(name(x)) > 1, F.substring(x, 1, 1)).otherwise(""), F.repeat(F.lit(MASK), F.greatest(F.char_length(name(x)) - 1, F.lit(1))))
    masked = _each_match(text, _EMAIL, lambda x: F.concat(stars(x), F.lit("@"), F.substring_index(x, "@", -1)))
    return F.when(F.contains(text, F.lit("@")), masked).otherwise(text)


def mask_sensitive(text: Column) -> Column:
    """Identity numbers (first 6 and last 4 stay), bank cards (last 4 digits), mobile numbers (first 3 and last 4), e-mail names, in this order.

    All that can hold a number has a run of eleven digits or grouped ones, so other texts are scanned once.
    """
    masked = _each_match(F.regexp_replace(text, _ID_CARD, "$1********$2"), _BANK_CARD, _masked_card)
    masked = F.regexp_replace(masked, _PHONE, "$1****$2")
    return mask_email(F.when(text.rlike(_DIGITS), masked).otherwise(text))


def clean(text: Column, watermarks: list[str] = (), replacements: list[tuple[str, str]] = (), mask: bool = True) -> Column:
    """Watermark patterns removed, patterns replaced by literal text, sensitive data masked, in this order."""
    out = text
    for pattern in watermarks:
        out = F.regexp_replace(out, pattern, "")
    for pattern, literal in replacements:
        out = F.regexp_replace(out, pattern, literal.replace("\\", "\\\\").replace("$", "\\$"))
    return mask_sensitive(out) if mask else out


def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Compatibility-normalised text; Spark has no such function of its own. ASCII texts are left as they are, and none of them goes to Python."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(F.pandas_udf(_nfkc, "string")(F.when(~plain, text)))


def text_hash(text: Column, compatible: bool = True) -> Column:
    """SHA-256 of a text without white space, NFKC first (leave that out for ASCII text: it stays in the JVM)."""
    return F.sha2(F.regexp_replace(nfkc(text) if compatible else text, r"[\s 　]+", ""), 256)


def query_digest(query: Column, chars: int = 200) -> Column:
    """A query for the logs: masked and cut."""
    return F.substring(mask_sensitive(query), 1, chars)


def query_hash(query: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(F.trim(query)), r"\s+", " "), 256)


def _gram_codes(texts: pa.Array) -> pa.Array:
    flat, ends = [np.zeros(0, np.int64)], [0]
    for text in texts.to_pylist():
        cps = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.int64)
        cps = cps[(cps != 0x20) & ((cps < 0x09) | (cps > 0x0D))]
        flat.append(np.unique(cps[:-2] << 42 | cps[1:-1] << 21 | cps[2:]) if len(cps) > 2 else flat[0])
        ends.append(ends[-1] + len(flat[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))


def gram_set(text: Column) -> Column:
    """Distinct 3-grams of a text without white space, each as one number (three code points of 21 bits): no hash, no collisions."""
    return F.arrow_udf(_gram_codes, "array<bigint>").asNondeterministic()(text)


def dice(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two sets; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def _shared_grams(sources: DataFrame, target: DataFrame, least: float) -> DataFrame:
    """(source_id, target_id, na, nb, c) of sources (source_id, g, na) and targets (id, text) of likeness least at least; c: how many grams they share."""
    held = sources.select("source_id", "g", "na").toArrow().combine_chunks()
    sizes = np.array(held["na"].to_pylist(), np.int64)
    grams, owner = np.array([x for g in held["g"].to_pylist() for x in g], np.int64), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(grams, kind="stable")
    known, begins = np.unique(grams[order], return_index=True)
    ends = np.append(begins[1:], len(grams))[: len(known)]
    index = sources.sparkSession.sparkContext.broadcast((held["source_id"].combine_chunks(), sizes, known, begins, ends, owner[order]))
    kinds = dict(sources.dtypes)["source_id"], dict(target.dtypes)["id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, na, known, begins, ends, owner = index.value
        for batch in batches:
            found = []
            for i in range(len(batch) if len(known) else 0):
                g = _gram_codes(batch.column("text").slice(i, 1)).values.to_numpy()
                at = np.searchsorted(known, g)
                at = at[known[np.minimum(at, len(known) - 1)] == g]
                n = ends[at] - begins[at]
                # All places from each begin to its end.
                places = np.repeat(begins[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                c = np.bincount(owner[places], minlength=len(na))
                near = np.flatnonzero((c > 0) & (2 * c >= (least - 1e-8) * (na + len(g))))
                found.append((near, np.full(len(near), i), c[near], np.full(len(near), len(g))))
            if found:
                near, row, c, nb = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(near)), batch.column("id").take(pa.array(row)), pa.array(na[near]), pa.array(nb.astype(np.int64)), pa.array(c.astype(np.int64))], names=["source_id", "target_id", "na", "nb", "c"])

    small_batches(target.sparkSession)
    return target.select("id", "text").mapInArrow(count, f"source_id {kinds[0]}, target_id {kinds[1]}, na bigint, nb bigint, c bigint")


def fuzzy_matches(source: DataFrame, target: DataFrame, least: float = 0.35, k: int = 3, shortest: int = 10) -> DataFrame:
    """For each source (id, text) the k targets (id, text) of most 3-gram Dice likeness, least at least.

    An equi-join on grams counts what two texts share; texts themselves meet nowhere. Up to GRAMS_SENT grams of sources are sent to
    where the targets lie, and only pairs that are alike enough become rows. A set can only be alike enough to one of at
    most (2 - least) / least times its size, so targets beyond the reach of all sources are not joined, and pairs out of
    reach not counted. Sources of fewer than shortest characters match nothing.
    """
    from pyspark.sql import Window as W

    from lexlake.operators.recall import small
    from lexlake.storage import materialize

    reach = (2 - least) / least
    a = source.filter(F.char_length("text") >= shortest).select(F.col("id").alias("source_id"), gram_set(F.col("text")).alias("g")).withColumn("na", F.size("g"))
    a = materialize(a, "source-grams")
    if (a.agg(F.coalesce(F.sum("na"), F.lit(0))).first()[0]) <= GRAMS_SENT:
        shared = _shared_grams(a, target, least)
    else:
        sizes = a.agg((F.min("na") / reach - 1).alias("lo"), (F.max("na") * reach + 1).alias("hi"))
        b = target.select(F.col("id").alias("target_id"), gram_set(F.col("text")).alias("g")).withColumn("nb", F.size("g"))
        b = b.join(F.broadcast(sizes), F.col("nb").between(F.col("lo"), F.col("hi"))).select("target_id", "nb", F.explode("g").alias("gram"))
        shared = b.join(small(a.select("source_id", "na", F.explode("g").alias("gram"))), "gram").filter((F.col("nb") <= F.col("na") * reach + 1) & (F.col("na") <= F.col("nb") * reach + 1))
        shared = shared.groupBy("source_id", "target_id", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    scored = shared.withColumn("score", F.round(2 * F.col("c") / (F.col("na") + F.col("nb")), 9)).filter(F.col("score") >= least)
    order = W.partitionBy("source_id").orderBy(F.col("score").desc(), "target_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("source_id", "target_id", "score", "rank")


def metadata_constant(value: str) -> Column:
    return _value(F.lit(value))


def metadata_regex(text: Column, pattern: str) -> Column:
    """First match: its group 1 if the pattern has one, else all of it."""
    import re

    return _value(F.regexp_extract(text, pattern, 1 if re.compile(pattern).groups else 0))


def metadata_keywords(text: Column, words: list[str]) -> Column:
    """The words that a text holds."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _value(x: Column) -> Column:
    """Cut to 256 characters; blank counts as absent."""
    return F.when(F.trim(x) != "", F.substring(x, 1, 256))


def graph_terms(query: Column, most: int = 32) -> Column:
    """Distinct terms: runs in SCRIPTS, and runs of two or more other letters and digits in lower case, up to 64 characters."""
    runs = F.regexp_extract_all(query, F.lit(rf"[\p{{L}}\p{{N}}&&[{SCRIPTS}]]+|[\p{{L}}\p{{N}}&&[^{SCRIPTS}]]+"), F.lit(0))
    own = lambda x: x.rlike(f"^[{SCRIPTS}]")
    cut = F.transform(runs, lambda x: F.substring(x, 1, 64))
    kept = F.transform(F.filter(cut, lambda x: own(x) | (F.char_length(x) >= 2)), lambda x: F.when(own(x), x).otherwise(F.lower(x)))
    return F.slice(F.array_distinct(kept), 1, most)


def login_wall(url: Column, html: Column) -> Column:
    """A password field, or both a login-like address and a login-like title."""
    weak = F.lower(url).rlike(_LOGIN_URL) & html.rlike(_LOGIN_TITLE)
    return F.coalesce(html.rlike(_PASSWORD), F.lit(False)) | F.coalesce(weak, F.lit(False))


def url_allowed(url: Column) -> Column:
    """http or https, no user part, and no loopback, private or link-local host."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    inside = host.rlike(r"^(localhost|.*\.local|.*\.internal|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|0\.0\.0\.0|\[.*\])$")
    return F.coalesce(url.rlike(r"^(?i:https?)://") & ~url.rlike(r"^[a-zA-Z]+://[^/?#]*@") & (host != "") & ~inside, F.lit(False))


def slug(key: Column, ext: Column, most: int = 200) -> Column:
    """A file name for an object: its key's last part without extension, lower-cased, other runs than a-z, 0-9 and
    ideographs to single dashes; the key hash's first eight; the extension. Cut in front to most characters."""
    name = F.substring_index(key, "/", -1)
    base = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")
    bare = F.regexp_replace(F.regexp_replace(F.lower(base), r"[^a-z0-9\u4e00-\u9fa5]+", "-"), r"^-+|-+$", "")
    suffix = F.concat(F.lit("-"), F.substring(F.sha2(key, 256), 1, 8), F.lit("."), ext)
    return F.concat(F.substring(bare, F.lit(1), F.lit(most) - F.char_length(suffix)), suffix)


def extension(name: Column) -> Column:
    """Lower-case extension of the last path part; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def fingerprint(*segments: Column) -> Column:
    """SHA-256 over the segments joined by |; a missing one is empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(s.cast("string"), F.lit("")) for s in segments)), 256)


def index_name(prefix: str, kb: Column, model: Column, dim: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), F.lower(kb), F.regexp_replace(F.lower(model), "[^a-z0-9]+", "-"), dim.cast("string"))


def snapshot_number(name: Column) -> Column:
    """n of a name that ends in _sn; null else."""
    return F.regexp_extract(name, r"_s(\d+)$", 1).try_cast("int")


def resolve_placeholders(text: Column, proxies: Column, label: str = "image") -> Column:
    """[[IMAGE:id]] becomes a line with the id's text from the map proxies; unknown ids go."""
    parts = F.split(text, r"(?=\[\[IMAGE:)|(?<=\]\])")
    key = lambda p: F.regexp_extract(p, r"^\[\[IMAGE:([^\]]+)\]\]$", 1)
    known = lambda p: F.coalesce(F.concat(F.lit(f"\n[{label}] "), F.try_element_at(proxies, key(p)), F.lit("\n")), F.lit(""))
    return F.array_join(F.transform(parts, lambda p: F.when(key(p) != "", known(p)).otherwise(p)), "")


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Non-blank pages of each document joined by blank lines: text and ranges (page_no, start, stop)."""
    kept = pages.filter(F.trim("text") != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    ranges = F.aggregate(
        "p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page_no:bigint,start:int,stop:int>>").alias("r")),
        lambda s, x: F.struct((s["at"] + F.char_length(x["text"]) + 2).alias("at"), F.concat(s["r"], F.array(F.struct(x["page_no"].cast("long").alias("page_no"), s["at"].alias("start"), (s["at"] + F.char_length(x["text"])).alias("stop")))).alias("r")),
    )
    return kept.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), ranges["r"].alias("ranges"))


def prompt_passages(passages: Column) -> Column:
    """Texts of an array as numbered passages."""
    return F.array_join(F.transform(passages, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def json_object(answer: Column) -> Column:
    """What lies between the first { and the last } of a model's answer; null without."""
    found = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def strip_fences(answer: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(answer, r"^\s*```[A-Za-z]*\s*", ""), r"\s*```\s*$", ""))


def truthy(value: Column) -> Column:
    """Whether a text is one of the words for true."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "y", "t", "是"), F.lit(False))


def parse_time_ms(value: Column) -> Column:
    """Epoch milliseconds of a number (seconds below 1e11) or of a time in the usual formats; null else."""
    number = F.trim(value).try_cast("double")
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    stamped = F.coalesce(*(F.unix_millis(F.try_to_timestamp(F.trim(value), F.lit(f))) for f in formats))
    return F.coalesce(F.when(number >= 1e11, number.cast("long")).when(number.isNotNull(), (number * 1000).cast("long")), stamped)


def message_type(value: Column) -> Column:
    """voice, video, image, text or other of a message's type word or code; blank is text.

    Latin words count as whole words, others anywhere; words go before codes.
    """
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    word = lambda w: rf"(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])" if w.isascii() else w
    out = F.when(v == "", "text")
    for kind, words, _ in MESSAGE_TYPES:
        out = out.when(v.rlike("|".join(map(word, words))), kind)
    code = F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), v.try_cast("double").cast("long"))
    for kind, _, codes in MESSAGE_TYPES:
        out = out.when(code.isin(*codes), kind)
    return out.otherwise("other")
