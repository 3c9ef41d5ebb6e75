"""Hard-negative mining with cover trees: positives and negatives of anchors by inner product, within score windows.

Rows are put into cover trees of a few thousand each. A coordinate is added so that all rows of a tree are equally
long, M; the distance of two rows then says their angle. A node whose rows lie within the angle r of its centre, which
itself stands at the angle a from the anchor q, scores between |q| M cos(a + r) and |q| M cos(a - r). A search descends from the node that may hold the
best score still wanted, skips nodes outside of all windows, and verifies rows by exact products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.llm.vectors import LEAST, MOST, Best, lengths_of, matrix, met, numbered, products, strips, widened
from lexlake.storage import materialize

#: Rows of a tree, and of a node that is not divided further.
TREE_ROWS, LEAF_ROWS = 2_048, 32


class CoverTree:
    """A tree over rows: per node a centre, its covering radius, rows of its own and child nodes.

    A node's children have centres more than half its radius apart, and cover its rows within half its radius, so radii
    at least halve from level to level; each node keeps the radius that its rows really take. Rows that stand alone
    under a node are held by the node itself, as are equal ones.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        norms = lengths_of(values)
        longest = float(norms.max(initial=0))
        if np.isfinite(longest * longest * 4):
            points = np.column_stack([values, np.sqrt(np.maximum(longest**2 - norms**2, 0))])
        else:  # beyond what distances can be taken of: one node of unknown radius
            points = None
        self.centre, self.radius, self.first, self.children = [], [], [], []
        self.own: list[np.ndarray] = []
        self._build(points)
        self.centre, self.radius, self.longest = np.array(self.centre), np.array(self.radius), longest
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            half = np.nan_to_num(self.radius / (2 * longest), nan=0.0, posinf=1.0)
        self.angle = 2 * np.arcsin(np.minimum(half, 1.0)) if points is not None else np.full(len(self.radius), np.pi)

    def _node(self, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.own.append(np.zeros(0, np.int64))
        self.children.append((0, 0))
        return len(self.centre) - 1

    def _build(self, points: np.ndarray | None) -> None:
        every = np.arange(len(self.values))
        if points is None:
            self.own[self._node(0, np.inf)] = every
            return
        root = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
        away = np.sqrt(((points - points[root]) ** 2).sum(axis=1))
        todo = [(self._node(root, float(away.max())), every, away)]
        while todo:
            node, members, away = todo.pop()
            if len(members) <= LEAF_ROWS or self.radius[node] == 0:
                self.own[node] = members
                continue
            under = points[members]
            nearest, belongs, centres = away.copy(), np.zeros(len(members), np.int64), [self.centre[node]]
            while True:
                far = int(nearest.argmax())
                if nearest[far] <= self.radius[node] / 2:
                    break
                d = np.sqrt(((under - under[far]) ** 2).sum(axis=1))
                closer = d < nearest
                nearest[closer], belongs[closer] = d[closer], len(centres)
                centres.append(int(members[far]))
            order = np.argsort(belongs, kind="stable")
            cuts = np.searchsorted(belongs[order], np.arange(len(centres) + 1))
            alone, first = [], len(self.centre)
            for k, c in enumerate(centres):
                group = order[cuts[k] : cuts[k + 1]]
                if len(group) == 1:
                    alone.append(members[group[0]])
                else:
                    todo.append((self._node(c, float(nearest[group].max())), members[group], nearest[group]))
            self.own[node] = np.array(alone, np.int64)
            self.children[node] = first, len(self.centre)


class Forest:
    """A tree with what is known of its rows."""

    def __init__(self, values: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.tree, self.ids, self.rows, self.labels = CoverTree(values), ids, rows, labels
        self.low, self.high = labels.min(), labels.max()
        self.centres = values[self.tree.centre]


class Windows:
    """Anchors, each with some windows of scores, and the k best in each of them."""

    def __init__(self, values: np.ndarray, rows: np.ndarray, labels: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        """owner: the anchor of each window, ascending. same: whether rows of the anchor's label are sought, or the others."""
        self.values, self.rows, self.labels, self.same = values, rows, labels, same
        self.low, self.high, self.best = low, high, Best(len(low), k)
        self.at = np.searchsorted(owner, np.arange(len(rows) + 1))
        self.norms = lengths_of(values)

    def search(self, anchor: int, forest: Forest) -> None:
        """Offer the rows of a tree to all windows of an anchor."""
        tree, label = forest.tree, self.labels[anchor]
        a, b = self.at[anchor], self.at[anchor + 1]
        if a == b or (self.same and not forest.low <= label <= forest.high) or (not self.same and forest.low == forest.high == label):
            return
        q, norm = self.values[anchor : anchor + 1], self.norms[anchor]
        low, high = self.low[a:b], self.high[a:b]
        best = self.best.least[a:b]  # a view: follows what is offered
        top = int(high.max())

        def bounds(nodes: slice) -> tuple[np.ndarray, np.ndarray]:
            most = norm * tree.longest
            if not np.isfinite(most * most):
                return np.full(nodes.stop - nodes.start, -np.inf), np.full(nodes.stop - nodes.start, np.inf)
            at = np.arccos(np.clip(forest.centres[nodes] @ q[0] / max(most, 1e-300), -1, 1))
            slack = 0.25 + 1e-6 * most
            return most * np.cos(np.minimum(at + tree.angle[nodes], np.pi)) - slack, most * np.cos(np.maximum(at - tree.angle[nodes], 0)) + slack

        heap: list[tuple[float, int, float, float]] = []

        def wanted(nodes: slice) -> None:
            lo, hi = bounds(nodes)
            need = np.maximum(low, best)
            fits = ((hi[:, None] >= need) & (lo[:, None] <= high)).any(axis=1)
            for n in np.flatnonzero(fits):
                heapq.heappush(heap, (-min(float(hi[n]), float(top)), nodes.start + int(n), float(lo[n]), float(hi[n])))

        wanted(slice(0, 1))
        while heap:
            most, node, lo, hi = heapq.heappop(heap)
            need = np.maximum(low, best)
            if -most < need.min():
                return
            if not ((hi >= need) & (lo <= high)).any():
                continue
            own = tree.own[node]
            if len(own):
                own = own[((forest.labels[own] == label) == self.same) & (forest.rows[own] != self.rows[anchor])]
            if len(own):
                score = products(q, tree.values[own])[0]
                for w in np.flatnonzero((need <= score.max()) & (high >= score.min())):
                    good = (score >= max(low[w], best[w])) & (score <= high[w])
                    if good.any():
                        self.best.offer(np.full(int(good.sum()), a + w), score[good], forest.ids[own[good]], forest.rows[own[good]])
            first, last = tree.children[node]
            if first < last:
                wanted(slice(first, last))


_TREE = "n int, v binary, ids binary, rows binary, labels binary"
_ASKED = "anchor_row long, anchor_id long, place int, vec_id long, row long, score long"


def _packed(rows: DataFrame, scale: int) -> DataFrame:
    """Rows in trees' shares of TREE_ROWS, by label: one row each, stored. A label of many rows has many."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(parts: list) -> pa.RecordBatch:
            width = max(x[0].shape[1] for x in parts)
            values = np.concatenate([widened(x[0], width) for x in parts])
            ids, rows, labels = (np.concatenate([x[k] for x in parts]) for k in (1, 2, 3))
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (values, ids, rows, labels))], names=["n", "v", "ids", "rows", "labels"])

        parts, n = [], 0
        for batch in batches:
            part = matrix(batch.column("v"), scale), *(batch.column(c).to_numpy() for c in ("id", "row", "label"))
            at = 0
            while at < batch.num_rows:
                take = min(TREE_ROWS - n, batch.num_rows - at)
                parts.append(tuple(x[at : at + take] for x in part))
                n, at = n + take, at + take
                if n == TREE_ROWS:
                    yield one(parts)
                    parts, n = [], 0
        if parts:
            yield one(parts)

    n = rows.count()
    dealt = rows.repartitionByRange(max(1, -(-n // (4 * TREE_ROWS))), "label", "row").sortWithinPartitions("label", "row")
    # Numbered one after the other, so that strips of them are even.
    number = F.expr("shiftright(number, 33) * 4 + (number & 8589934591)")
    packed = dealt.select("v", "id", "row", "label").mapInArrow(pack, _TREE).withColumn("number", F.monotonically_increasing_id())
    return materialize(packed.withColumn("number", number), "cover-trees")


def _searched(anchors: DataFrame, shares: DataFrame, n_anchors: int, n_rows: int, k: int, same: bool, scale: int) -> DataFrame:
    """_ASKED: the k best of each window of each anchor (row, id, label, v, windows array<struct<low, high>>), of each strip of trees."""
    p, r = strips(anchors, n_anchors, n_rows)
    r = max(1, min(r, -(-n_rows // TREE_ROWS)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        state: Windows | None = None
        ids = owner = np.zeros(0, np.int64)
        for batch in batches:
            side = batch.column("side").to_numpy()
            n = int(np.searchsorted(side, 1))
            if n:
                part = batch.slice(0, n)
                windows = part.column("windows")
                flat = windows.flatten()
                held.append((matrix(part.column("v"), scale), *(part.column(c).to_numpy() for c in ("id", "row", "label")), windows.value_lengths().to_numpy(), flat.field("low").to_numpy(), flat.field("high").to_numpy()))
            if n == batch.num_rows:
                continue
            if not held:
                return
            if state is None:
                width = max(x[0].shape[1] for x in held)
                values = np.concatenate([widened(x[0], width) for x in held])
                ids, rows, labels, counts, low, high = (np.concatenate([x[j] for x in held]) for j in range(1, 7))
                owner = np.repeat(np.arange(len(ids)), counts)
                state = Windows(values, rows, labels, owner, low, high, same, k)
            for share in batch.slice(n).select(["n", "tree", "ids", "rows", "labels"]).to_pylist():
                tree = np.frombuffer(share["tree"], np.float64).reshape(share["n"], -1)
                width = max(tree.shape[1], state.values.shape[1])
                state.values = widened(state.values, width)
                forest = Forest(widened(tree, width), *(np.frombuffer(share[c], np.int64) for c in ("ids", "rows", "labels")))
                for anchor in range(len(ids)):
                    state.search(anchor, forest)
        if state is not None:
            w, score, found, numbers = state.best.found()
            who = owner[w]
            out = state.rows[who], ids[who], (w - state.at[who]).astype(np.int32), found, numbers, score
            for a in range(0, len(w), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in out], names=["anchor_row", "anchor_id", "place", "vec_id", "row", "score"])

    none = lambda *names, kind: [F.lit(None).cast(kind).alias(x) for x in names]
    window = "array<struct<low: bigint, high: bigint>>"
    kind = dict(anchors.dtypes)["v"]
    asking = anchors.select("row", "id", "label", "v", "windows", *none("n", kind="int"), *none("tree", "ids", "rows", "labels", kind="binary"))
    number = F.col("number").alias("row")
    asked = shares.select(number, *none("id", "label", kind="long"), *none("v", kind=kind), *none("windows", kind=window), "n", F.col("v").alias("tree"), "ids", "rows", "labels")
    return met(asking, asked, p, r).drop("cell").mapInArrow(search, _ASKED)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor_row", "place").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(scale * x). An anchor (is_anchor, a condition on id) has as positives its best
    other rows of the same label; for each of them the best rows of other labels whose score is from least to most
    percent of the positive's are returned. Higher scores come first, then smaller ids. label is an SQL expression over
    vectors. Rows with a null label, key or vector, or a null or non-finite component, take no part; rows that repeat an id
    or a vector count one by one. A positive of score 0 has negatives of score 0 only, one below 0 none. Vectors of
    different lengths count as filled up with zeros; scores beyond 64 bits stay at the largest or least.

    Two passes over stored shares of TREE_ROWS rows: positives from all rows, then negatives within their windows.
    """
    rows = numbered(vectors, key, vector, scale, label=f"CAST({label} AS BIGINT)").filter("label IS NOT NULL")
    anchors = rows.filter(is_anchor)
    n, n_anchors = rows.count(), anchors.count()
    shares = _packed(rows, scale)
    every = F.array(F.struct(F.lit(LEAST).cast("long").alias("low"), F.lit(MOST).cast("long").alias("high")))
    own = _ranked(_searched(anchors.select("row", "id", "label", "v", every.alias("windows")), shares, n_anchors, n, positives, True, scale), positives)
    own = materialize(own.select("anchor_row", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    s = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(s * least / 100), F.floor(s * most / 100)
    asked = own.select("anchor_row", "place", low.cast("long").alias("low"), high.cast("long").alias("high"))
    windows = asked.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("w"))
    windows = windows.select("anchor_row", F.transform("w", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("windows"))
    asking = anchors.join(windows, F.col("row") == F.col("anchor_row")).select("row", "id", "label", "v", "windows")
    found = _ranked(_searched(asking, shares, n_anchors, n, negatives, False, scale), negatives)
    return (
        found.withColumn("place", F.col("place") + 1).join(own, ["anchor_row", "place"])
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
