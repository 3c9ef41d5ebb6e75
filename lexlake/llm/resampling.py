"""Importance resampling towards a target distribution by hashed n-grams.

Each text's features are runs of words, hashed to buckets by CRC-32. Buckets are counted in the corpus and in the
target; a text's weight is the mean log ratio of its buckets, and Gumbel noise turns the highest weights into a draw.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.llm.scan import LOWER, blocks, ragged, span_hashes, spans
from lexlake.storage import materialize

#: The reversed CRC-32 polynomial of zlib.
_POLYNOMIAL = 0xEDB88320

#: Bytes of words: digits, small letters and all of non-ASCII characters.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of one length's matrix that are looked at together.
MATRIX_BYTES = 1 << 22


def _table() -> np.ndarray:
    """What each last byte does to a CRC."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(_POLYNOMIAL) * (t & np.uint32(1)))
    return t


_CRC = _table()


def crc_columns(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional array of bytes, all rows at once and column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = (crc >> np.uint32(8)) ^ _CRC[(crc ^ column) & np.uint32(0xFF)]
    return ~crc


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] of each span (ascending starts, ascending ends), by length.

    Distinct bytes are found by hash among spans of equal length and compared byte by byte with the first of their
    hash, so spans that only share a hash get CRCs of their own.
    """
    out = np.zeros(len(starts), np.uint32)
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    cuts = [*np.flatnonzero(np.diff(lengths[order], prepend=-1)), len(order)]
    for a, b in itertools.pairwise(cuts):
        n = int(lengths[order[a]])
        step = max(1, MATRIX_BYTES // max(n, 1))
        for c in range(a, b, step):
            part = order[c : min(b, c + step)]
            matrix = data[starts[part][:, None] + np.arange(n)]
            key = matrix_keys(matrix)
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            found = crc_columns(matrix[first])[which]
            if n > 8:
                other = np.flatnonzero((matrix != matrix[first[which]]).any(axis=1))
                found[other] = crc_columns(matrix[other])
            out[part] = found
    return out


def matrix_keys(matrix: np.ndarray) -> np.ndarray:
    """64 bits for each row of bytes: the bytes themselves up to 8, a hash of longer ones."""
    rows, n = matrix.shape
    if n <= 8:
        wide = np.zeros((rows, 8), np.uint8)
        wide[:, :n] = matrix
        return wide.view(np.uint64)[:, 0]
    at = np.arange(rows + 1) * n
    return span_hashes(matrix.reshape(-1), at[:-1], at[1:])


def joined_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts between the offsets, lower-cased and each followed by one space: bytes, starts, ends, and each text's first word (n + 1)."""
    low = LOWER[data]
    starts, ends = spans(_INSIDE[low], at)
    lengths = ends - starts + 1
    after = np.cumsum(lengths)
    out = low[np.minimum(ragged(starts, lengths), max(len(low) - 1, 0))] if len(starts) else np.zeros(0, np.uint8)
    out[after - 1] = 0x20
    return out, after - lengths, after - 1, np.searchsorted(starts, at)


def features(data: np.ndarray, at: np.ndarray, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all runs of 1 to most words, repeats included, by the number of words."""
    text, starts, ends, first = joined_words(data, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    for n in range(1, most + 1):
        m = max(0, len(starts) - n + 1)
        inside = np.flatnonzero(owner[:m] == owner[n - 1 : n - 1 + m])
        yield owner[inside], (crcs(text, starts[inside], ends[inside + n - 1]) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str = "text", most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) over all texts; a task's counts are summed before they are shuffled. Null texts have no features."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, at in blocks(batch.column(0)):
                for _, found in features(data, at, most, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    parts = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln(((t + 1) (S + buckets)) / ((s + 1) (T + buckets)))) of each bucket, of counts (bucket, n)."""
    both = corpus.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in both.collect():  # at most one row a bucket
        s[row.bucket], t[row.bucket] = row.s, row.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights_of(text: Column, gain: np.ndarray, most: int = 1) -> Column:
    """Struct (n_features, weight): how many features a text has, and the floored mean of their gains; none: 0."""

    def weigh(texts: pa.Array) -> pa.Array:
        n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, j, data, at in blocks(texts):
            for owner, found in features(data, at, most, len(gain)):
                n[i:j] += np.bincount(owner, minlength=j - i)
                at_end = np.append(0, np.cumsum(gain[found]))
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                total[i:j] += np.diff(at_end[cut])
        return pa.StructArray.from_arrays([pa.array(n), pa.array(total // np.maximum(n, 1))], names=["n_features", "weight"])

    return F.arrow_udf(weigh, "struct<n_features: bigint, weight: bigint>").asNondeterministic()(text.cast("string"))


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 8 hex digits of sha256 of seed:key; a null key counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def with_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank, 1, 2, 3... over all of them: sorted in ranges, numbered within each, and moved by what the ranges before hold.

    The order should leave no large group of equal rows, which would fall into one range.
    """
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = rows.repartitionByRange(int(n), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    before = np.cumsum([0, *(c for _, c in counts)])
    if not counts:
        return placed.withColumn("rank", F.lit(None).cast("long")).drop("__at")
    moved = F.element_at(F.create_map(*(F.lit(int(x)).cast("long") for (p, _), b in zip(counts, before, strict=False) for x in (p, b))), part)
    return placed.withColumn("rank", moved + place + 1).drop("__at")


def importance_resampling(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = 10_000, least_features: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Per row: key, n_features, weight, score, rank (of those drawn, else null).

    Features are runs of 1 to most words of a text, A-Z lower-cased. Of the rows with at least least_features words'
    features, percent in a hundred are drawn, those with the highest scores; ties go to the smaller key, a null key
    last. Null and empty texts have no features, weight 0, and are not drawn (unless least_features is 0). Repeated rows
    count and are drawn one by one. Empty tables: counts are 0, and no rows return for no documents.

    Texts are read twice, for counts and for weights, and never shuffled; what is sorted is a few numbers a row.
    """
    gain = gains(bucket_counts(docs, text, most, buckets), bucket_counts(target, target_text, most, buckets), buckets)
    weighed = docs.select(F.col(f"`{key}`").alias("key"), weights_of(F.col(f"`{text}`"), gain, most).alias("w")).select("key", "w.*")
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("key"), seed)).withColumn("tie", F.monotonically_increasing_id()), "weights")
    enough = scored.filter(F.col("n_features") >= least_features)
    draw = enough.count() * percent // 100
    ranked = with_rank(enough, F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("tie")).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.filter(F.col("n_features") < least_features).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
