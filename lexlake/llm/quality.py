"""Quality rules per document and verdicts per host.

A document's counts come from one vectorised scan of its text. Rule failures are summed by host; a host's
failure rate is shrunk towards the rate of all hosts with a beta prior fitted to the hosts' rates by moments,
so a host with few documents is not judged on chance; documents of failing hosts go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm.scan import WHITE, blocks, counted, mix, span_hashes, spans, words
from lexlake.storage import BROADCAST_ROWS, materialize

#: A host fails when its shrunk rate of failing documents is above this.
HOST_RATE = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether an equal key of the same owner exists; whether one comes earlier."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order], later[order] = same[1:] | same[:-1], same[:-1]
    return twice, later


def text_counts(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text between the offsets."""
    n = len(at) - 1

    h, starts, _, first = words(data, at)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(n), n_words)
    chars = counted(~WHITE[data] & ((data & 0xC0) != 0x80), at)

    line_starts, line_ends = spans(data != 0x0A, at)
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_owner = np.searchsorted(at, line_starts, "right") - 1
    again = _repeated(span_hashes(data, line_starts, line_ends), line_owner)[1]
    dup_lines = np.bincount(line_owner[again], minlength=n)

    if len(h) > 2:
        inside = owner[2:] == owner[:-2]
        window = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
        twice = np.zeros(len(h), bool)
        twice[:-2][inside] = _repeated(window[inside], owner[:-2][inside])[0]
        marked = twice.copy()
        marked[1:] |= twice[:-1]
        marked[2:] |= twice[:-2]
        repeat = np.bincount(owner[marked], minlength=n)
    else:
        repeat = np.zeros(n, np.int64)
    return [n_words, chars, counted(_SYMBOLS[data], at), dup_lines, repeat]


COUNTED = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def counts_of(text: Column) -> Column:
    """Struct of COUNTS of a text column. Null counts as empty: zeros. Only the text goes to Python; no shuffle."""

    def count(texts: pa.Array) -> pa.Array:
        found = [np.stack(text_counts(data, at)) for _, _, data, at in blocks(texts)]
        each = np.concatenate(found, axis=1) if found else np.zeros((len(COUNTS), 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in each], names=list(COUNTS))

    # Marked so that a filter on the result is not moved before it and computed once more.
    return F.arrow_udf(count, COUNTED).asNondeterministic()(text.cast("string"))


def quality_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS added and the text taken away."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, counts_of(F.col(text)).alias("__counts")).select(*rest, "__counts.*")


def base_failed() -> F.Column:
    """Too short, or mostly made of repeated passages."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "base_failed", limit: float = HOST_RATE) -> DataFrame:
    """Per host: n, n_failed, shrunk_rate, host_failed.

    The prior Beta(a, b) has the mean m of all documents' failures and a strength a + b from the spread of the
    hosts' rates beyond what chance gives (method of moments, hosts weighed by their documents); without such spread
    the strength is the largest allowed, the mean number of documents of a host times 100, and all rates lie near m.
    A null host is a host of its own.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n")
    total = hosts.agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("hosts"), (F.sum("n_failed") / F.sum("n")).alias("m"), F.sum(F.col("n") * rate * rate).alias("s2"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    # Weighted variance between hosts and what binomial chance contributes to it.
    spread = F.col("s2") / F.col("docs") - F.col("m") * F.col("m")
    chance = F.col("m") * (1 - F.col("m")) * F.col("hosts") / F.col("docs")
    between = F.greatest(spread - chance, F.lit(0.0))
    most = F.lit(100.0) * F.col("docs") / F.col("hosts")
    strength = F.when(between > 0, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / between - 1, F.lit(1.0)), most)).otherwise(most)
    prior = total.select("m", strength.alias("strength"))
    shrunk = (F.col("n_failed") + F.col("strength") * F.col("m")) / (F.col("n") + F.col("strength"))
    return hosts.join(F.broadcast(prior)).select("host", "n", "n_failed", shrunk.alias("shrunk_rate"), (shrunk > limit).alias("host_failed"))


def with_host_verdict(judged: DataFrame, host: str = "source", failed: str = "base_failed", limit: float = HOST_RATE) -> DataFrame:
    """judged with kept: false where a row's own rules or its host fail. Rows repeat as they do in judged.

    Only failing hosts are joined back: broadcast while they are at most BROADCAST_ROWS, else by a shuffle that
    adaptive execution splits where one host is hot.
    """
    bad = host_verdicts(judged, host, failed, limit).filter("host_failed").select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
    bad = materialize(bad, "failing-hosts")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    joined = judged.join(bad, F.col(host).eqNullSafe(F.col("__host")), "left")
    return joined.withColumn("kept", ~F.col(failed) & F.col("__bad").isNull()).drop("__host", "__bad")


def quality_rules(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Per row: key, COUNTS, base_failed, kept. Null or empty texts have no words and fail."""
    counted = quality_counts(docs.select(F.col(key).alias("__key"), F.col(host).alias("__host_of"), F.col(text).alias("text")))
    # Stored, so that texts are read once though the hosts' rates are needed before the verdicts.
    judged = materialize(counted.withColumn("base_failed", base_failed()), "quality-counts")
    return with_host_verdict(judged, "__host_of").select(F.col("__key").alias(key), *COUNTS, "base_failed", "kept")
