"""Vectors as whole numbers: rows that take part, exact products, the best of many, and cells of a grid.

Searches meet queries and candidates in cells: queries are dealt to strips, candidates to others, and each pair of
strips is one task, in which queries are held and candidates stream by. Rows are dealt by their number, so strips are
even whatever the ids or vectors are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.scan import ragged
from lexlake.storage import materialize

#: Queries that a task holds at most, candidates that one should see at most, and those that make a strip worth while.
QUERY_STRIP, CANDIDATE_STRIP, LEAST_STRIP = 65_536, 1 << 20, 2_048

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def numbered(df: DataFrame, key: str, vector: str, scale: int, **more: str) -> DataFrame:
    """(row, id, norm, v, ...) of the rows that take part, stored: row numbers them, norm is the length of floor(scale * x).

    Rows whose key or vector is null take no part, nor those with a null or non-finite component. more: further
    columns by their new names.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    named = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), *(F.expr(x).alias(n) for n, x in more.items()))
    kept = named.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(scale * x.cast("double")).cast("double"), 2)))
    return materialize(kept.withColumn("norm", norm).withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of a column of lists, as doubles; shorter lists are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.repeat(np.arange(len(lengths)), lengths), ragged(np.zeros(len(lengths), np.int64), lengths)] = np.floor(scale * flat)
    return out


def widened(values: np.ndarray, width: int) -> np.ndarray:
    """values with zeros up to so many columns."""
    return values if values.shape[1] >= width else np.pad(values, ((0, 0), (0, width - values.shape[1])))


def lengths_of(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((values * values).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers (doubles), as 64-bit integers above LEAST; those beyond stay at the ends.

    Floats are used where no sum can pass what they hold exactly.
    """
    with np.errstate(over="ignore"):
        bound = a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a).astype(object) @ whole(b).astype(object).T
    return np.clip(exact, LEAST + 1, MOST).astype(np.int64)


class Best:
    """The k best (score, id, row) of each of n queries: higher scores first, then smaller ids, then smaller rows."""

    def __init__(self, n: int, k: int):
        self.k, self.held = k, np.zeros(n, np.int64)
        self.scores = np.full((n, k), LEAST)
        self.ids, self.rows = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    @property
    def least(self) -> np.ndarray:
        """What a score must reach to come in: the k-th so far, or the least number."""
        return self.scores[:, -1]

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take what is good enough of these; several may be for one query."""
        if not len(query):
            return
        who = np.unique(query)
        n = self.held[who]
        place = ragged(np.zeros(len(who), np.int64), n)
        old = np.repeat(who, n)
        q = np.concatenate([old, query])
        s, i, r = (np.concatenate([x[old, place], y]) for x, y in ((self.scores, score), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((r, i, ~s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, place = order[place < self.k], q[place < self.k], place[place < self.k]
        self.scores[q, place], self.ids[q, place], self.rows[q, place] = s[order], i[order], r[order]
        self.held[who] = np.bincount(np.searchsorted(who, q), minlength=len(who))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id, row) of all that are held."""
        q, place = np.repeat(np.arange(len(self.held)), self.held), ragged(np.zeros(len(self.held), np.int64), self.held)
        return q, self.scores[q, place], self.ids[q, place], self.rows[q, place]


def strips(df: DataFrame, queries: int, candidates: int) -> tuple[int, int]:
    """Strips of queries and of candidates: bounded, and cells enough for all cores while strips stay worth while."""
    p = max(1, -(-queries // QUERY_STRIP))
    wanted = -(-2 * df.sparkSession.sparkContext.defaultParallelism // p)
    return p, max(1, -(-candidates // CANDIDATE_STRIP), min(wanted, candidates // LEAST_STRIP))


def met(queries: DataFrame, candidates: DataFrame, p: int, r: int, number: str = "row", *order) -> DataFrame:
    """Queries and candidates, of the same columns, in p * r partitions: those of each pair of strips in one.

    side is 0 for queries and 1 for candidates; within a cell queries come first, then candidates in the given order.
    """
    strip = lambda n: F.pmod(F.col(number), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = queries.select("*", F.lit(0).alias("side"), strip(p).alias("own"), every(r).alias("other")).withColumn("cell", F.col("own") * r + F.col("other"))
    asked = candidates.select("*", F.lit(1).alias("side"), strip(r).alias("own"), every(p).alias("other")).withColumn("cell", F.col("other") * r + F.col("own"))
    both = asking.unionByName(asked).drop("own", "other")
    return both.repartitionById(p * r, F.col("cell").cast("int")).sortWithinPartitions("cell", "side", *order)
