"""Exact top-k search by inner product: candidates in buckets of like length, pruned by length or by coordinates.

A query's k-th score so far, divided by its length and a bucket's longest vector, is the cosine that a vector of this
bucket must reach. Above 1 nothing in this or any later (shorter) bucket can come in. A high one bounds each
coordinate of a unit vector that reaches it, so the query's largest coordinates pick few vectors; with a low one the
least length that still suffices cuts the bucket. What is left is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.llm.vectors import LEAST, Best, lengths_of, matrix, met, numbered, products, strips, widened

#: Most rows of a bucket, and how much shorter than its longest a vector of it may be.
BUCKET_ROWS, BUCKET_SHARE = 2_048, 0.9
#: Local cosine from which a bucket is searched by coordinates, and how many of a query's largest are used.
COSINE, FOCUS = 0.75, 3
#: Scores that are looked at together.
TOGETHER = 1 << 20


class Bucket:
    """Vectors of like length, longest first."""

    def __init__(self, values: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.norms = lengths_of(values)
        order = np.argsort(-self.norms, kind="stable")
        self.values, self.ids, self.rows, self.norms = values[order], ids[order], rows[order], self.norms[order]
        self.longest = self.norms[0]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """One coordinate of the unit vectors in ascending order, and whose it is; sorted when first asked for."""
        if f not in self._sorted:
            unit = self.values[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(unit, kind="stable")
            self._sorted[f] = unit[order], order
        return self._sorted[f]

    def within(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Vectors that may reach the cosine with this unit vector, judged by its FOCUS largest coordinates.

        A unit vector x with x . q >= t has q_f * t - s <= x_f <= q_f * t + s, s = sqrt((1 - t^2)(1 - q_f^2)), where a
        side on which x_f could leave the interval [-1, 1] only by agreeing more with q is open.
        """
        left = None
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            x, slack = unit[f], np.sqrt(max(0.0, 1 - cosine * cosine) * max(0.0, 1 - unit[f] ** 2)) + 1e-9
            low = -np.inf if x <= -cosine else x * cosine - slack
            high = np.inf if x >= cosine else x * cosine + slack
            values, order = self.coordinate(int(f))
            fits = order[np.searchsorted(values, low) : np.searchsorted(values, high, "right")]
            left = fits if left is None else np.intersect1d(left, fits, assume_unique=True)
            if not len(left):
                break
        return left


def buckets(norms: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of descending lengths: at most BUCKET_ROWS, none shorter than BUCKET_SHARE of its longest."""
    a = 0
    while a < len(norms):
        b = min(a + BUCKET_ROWS, a + int(np.searchsorted(-norms[a:], -BUCKET_SHARE * norms[a], "right")))
        b = max(b, a + 1)
        yield a, b
        a = b


class Search:
    """Queries with their k best so far; buckets may come in any order, longest first prunes most."""

    def __init__(self, values: np.ndarray, rows: np.ndarray, k: int):
        self.values, self.rows, self.norms, self.best = values, rows, lengths_of(values), Best(len(values), k)
        self.by_row = np.argsort(rows)

    def _own(self, who: np.ndarray, bucket: Bucket) -> tuple[np.ndarray, np.ndarray]:
        """Places in a table of who by bucket at which a query meets itself."""
        order = np.argsort(bucket.rows)
        at = np.minimum(np.searchsorted(bucket.rows, self.rows[who], sorter=order), len(order) - 1)
        hit = np.flatnonzero(bucket.rows[order[at]] == self.rows[who])
        return hit, order[at[hit]]

    def meet(self, bucket: Bucket) -> None:
        width = max(self.values.shape[1], bucket.values.shape[1])
        bucket.values, self.values = widened(bucket.values, width), widened(self.values, width)
        reach = self.norms * bucket.longest
        active = np.flatnonzero(~(reach * (1 + 1e-9) + 0.25 < self.best.least))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach[active] > 0, (self.best.least[active] - 0.25) / reach[active], -1.0)
        close = (cosine >= COSINE) & np.isfinite(reach[active])
        for q, t in zip(active[close], cosine[close], strict=True):
            self._by_coordinates(q, float(t), bucket)
        rest = active[~close]
        step = max(1, TOGETHER // len(bucket.ids))
        for a in range(0, len(rest), step):
            self._by_length(rest[a : a + step], bucket)

    def _by_coordinates(self, q: int, cosine: float, bucket: Bucket) -> None:
        found = bucket.within(self.values[q] / self.norms[q], min(1.0, cosine) - 1e-9)
        found = found[bucket.rows[found] != self.rows[q]]
        if len(found):
            score = products(self.values[q : q + 1], bucket.values[found])[0]
            good = score >= self.best.least[q]
            self.best.offer(np.full(int(good.sum()), q), score[good], bucket.ids[found[good]], bucket.rows[found[good]])

    def _by_length(self, who: np.ndarray, bucket: Bucket) -> None:
        least = self.best.least[who]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((least > 0) & (self.norms[who] > 0), (least - 0.25) / self.norms[who] * (1 - 1e-9), 0.0)
        n = int(np.searchsorted(-bucket.norms, -need.min(), "right"))
        if not n:
            return
        score = products(self.values[who], bucket.values[:n])
        hit, at = self._own(who, bucket)
        score[hit[at < n], at[at < n]] = LEAST
        k = self.best.k
        many = np.flatnonzero((score >= least[:, None]).sum(axis=1) > k)
        if len(many):  # no need to look at more than what is at least as good as the k-th of these
            least = least.copy()
            least[many] = np.maximum(least[many], np.partition(score[many], n - k, axis=1)[:, n - k])
        i, j = np.nonzero((score >= least[:, None]) & (score > LEAST))
        self.best.offer(who[i], score[i, j], bucket.ids[j], bucket.rows[j])


_FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows by the inner product of floor(scale * x).

    is_query is a condition on the column id. Higher scores come first, then smaller ids; a query has fewer than k
    rows only if there are no more. Rows with a null key or vector, or with a null or non-finite component, take no
    part. Rows that repeat an id, a vector or both count one by one, as queries too. Vectors of different lengths count
    as filled up with zeros; scores beyond 64 bits stay at the largest or least. Other columns are not read.

    Work is queries times candidates less what is pruned: a task holds at most QUERY_STRIP queries and streams its
    candidates by, longest first.
    """
    rows = numbered(vectors, key, vector, scale)
    queries = rows.filter(is_query)
    p, r = strips(rows, queries.count(), rows.count())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        state: Search | None = None
        ids = np.zeros(0, np.int64)

        def joined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            width = max(x[0].shape[1] for x in parts)
            return np.concatenate([widened(x[0], width) for x in parts]), np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])

        def work(last: bool) -> None:
            values, own, numbers = joined(waiting)
            norms = lengths_of(values)
            done = 0
            for a, b in buckets(norms):
                if b < len(norms) or last:
                    state.meet(Bucket(values[a:b], own[a:b], numbers[a:b]))
                    done = b
            waiting[:] = [(values[done:], own[done:], numbers[done:])] if done < len(norms) else []

        for batch in batches:
            side = batch.column("side").to_numpy()
            n = int(np.searchsorted(side, 1))
            part = matrix(batch.column("v"), scale), batch.column("id").to_numpy(), batch.column("row").to_numpy()
            if n:
                held.append(tuple(x[:n] for x in part))
            if n < len(side):
                if state is None:
                    if not held:
                        return
                    values, ids, numbers = joined(held)
                    state = Search(values, numbers, k)
                waiting.append(tuple(x[n:] for x in part))
                if sum(len(x[1]) for x in waiting) > BUCKET_ROWS:
                    work(last=False)
        if state is None:
            return
        if waiting:
            work(last=True)
        q, score, found, numbers = state.best.found()
        for a in range(0, len(q), 100_000):
            s = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (state.rows[q[s]], ids[q[s]], numbers[s], found[s], score[s])], names=["query_row", "query_id", "row", "vec_id", "score"])

    cells = met(queries, rows, p, r, "row", F.col("norm").desc())
    best = cells.select("side", "row", "id", "v").mapInArrow(search, _FOUND)
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
