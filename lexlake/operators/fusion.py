"""Fusion of ranked routes and what follows until the answer: candidates, units, thresholds, budgets.

A ranked route is (query_id, route, chunk_id, score); all orders end with the id, so results never depend on chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Routes in the order that breaks ties between them. Fixed values.
ROUTES = ("VECTOR", "BM25", "MULTIMODAL", "GRAPH")
#: Spread of scores below which all count as equal.
EPSILON = 1e-9


def route_order(route: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROUTES)), route)


def _over(*by: str) -> W:
    return W.partitionBy(*by)


def with_rank(routes: DataFrame) -> DataFrame:
    """Rank within a query's route, from 1."""
    return routes.withColumn("rank", F.row_number().over(_over("query_id", "route").orderBy(F.col("score").desc(), "chunk_id")))


def _per_route(value: str) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", value))))


def rrf(routes: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: fused_score = sum of 1 / (k + rank), with ranks and scores by route and the best source."""
    if k <= 0:
        raise ValueError("k must be positive")
    ranked = with_rank(routes).withColumn("o", route_order(F.col("route")))
    fused = ranked.groupBy("query_id", "chunk_id").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("o", "rank"))), F.lit(0.0), lambda s, x: s + 1.0 / (k + x["rank"])).alias("fused_score"),
        F.min_by("route", F.struct("rank", "o")).alias("primary_source"), _per_route("rank").alias("route_ranks"), _per_route("score").alias("route_scores"),
    )
    return fused.withColumn("position", F.row_number().over(_over("query_id").orderBy(F.col("fused_score").desc(), "chunk_id")))


def minmax(score: Column, window, equal: float) -> Column:
    """Score within its window mapped to 0..1; equal where all scores are."""
    low, high = F.min(score).over(window), F.max(score).over(window)
    return F.when(high - low <= EPSILON, F.lit(equal)).otherwise((score - low) / (high - low))


def weighted_fusion(routes: DataFrame, w_vector: float = 0.6) -> DataFrame:
    """Weighted sum of min-max normalised scores: vectors w_vector, full text the rest, other routes nothing. Equal scores become 1."""
    normal = with_rank(routes).withColumn("norm", minmax(F.col("score"), _over("query_id", "route"), 1.0)).withColumn("o", route_order(F.col("route")))
    weight = F.when(F.col("route") == "VECTOR", w_vector).when(F.col("route") == "BM25", 1 - w_vector).otherwise(0.0)
    fused = normal.withColumn("part", weight * F.col("norm")).groupBy("query_id", "chunk_id").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("o", "part"))), F.lit(0.0), lambda s, x: s + x["part"]).alias("fused_score"),
        F.min_by("route", F.struct("rank", "o")).alias("primary_source"), _per_route("norm").alias("normalized_scores"),
    )
    return fused.withColumn("position", F.row_number().over(_over("query_id").orderBy(F.col("fused_score").desc(), "chunk_id")))


def fuse(routes: DataFrame, mode: str = "RRF", k: int = 60, w_vector: float = 0.6, has_graph: bool = False) -> DataFrame:
    """Fusion by mode. A graph route has no comparable scores, so it can't be weighted."""
    if mode == "RRF":
        return rrf(routes, k)
    if mode != "WEIGHTED":
        raise ValueError(f"unknown fusion mode {mode}")
    if has_graph:
        raise ValueError("the graph route can't take part in weighted fusion")
    return weighted_fusion(routes, w_vector)


def cross_kb_rrf(ranked: DataFrame, k: int = 60) -> DataFrame:
    """Rankings of several knowledge bases (query_id, kb_id, chunk_id, fused_score) as one: 1 / (k + rank in its base)."""
    inner = _over("query_id", "kb_id").orderBy(F.col("fused_score").desc(), "chunk_id")
    out = ranked.withColumn("kb_rank", F.row_number().over(inner)).withColumn("fused_score", 1.0 / (k + F.col("kb_rank")))
    return out.withColumn("position", F.row_number().over(_over("query_id").orderBy(F.col("fused_score").desc(), "chunk_id")))


def kb_quota(bases: DataFrame, total: int, *by: str) -> DataFrame:
    """(kb_id, weight, decl_order) with quota: shares of total by weight, rounded down; the rest to the heaviest, first declared.

    Weights that are null or not positive count as 1. by: columns of requests that are dealt with each for itself.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1)
    every = W.partitionBy(*by)  # a request names few knowledge bases
    out = bases.withColumn("w", weight).withColumn("quota", F.floor(total * F.col("w") / F.sum("w").over(every)).cast("long"))
    first = F.row_number().over(every.orderBy(F.col("w").desc(), "decl_order")) == 1
    return out.withColumn("quota", F.col("quota") + F.when(first, total - F.sum("quota").over(every)).otherwise(0)).drop("w")


def merge_across_kbs(ranked: DataFrame, bases: DataFrame, total: int = 50, k: int = 60) -> DataFrame:
    """Each query's contributing bases' best, up to their quotas among them, merged by cross_kb_rrf.

    A query with one contributing base keeps that base's whole ranking and scores.
    """
    given = ranked.select("query_id", "kb_id").distinct()
    quota = kb_quota(given.join(F.broadcast(bases), "kb_id"), total, "query_id").select("query_id", "kb_id", "quota", F.count(F.lit(1)).over(W.partitionBy("query_id")).alias("n"))
    inner = _over("query_id", "kb_id").orderBy(F.col("fused_score").desc(), "chunk_id")
    rows = ranked.withColumn("r", F.row_number().over(inner)).join(quota, ["query_id", "kb_id"]).filter((F.col("n") == 1) | (F.col("r") <= F.col("quota")))
    score = F.when(F.col("n") == 1, F.col("fused_score")).otherwise(1.0 / (k + F.col("r")))
    merged = rows.withColumn("fused_score", score).withColumn("kb_rank", F.col("r"))
    return merged.withColumn("position", F.row_number().over(_over("query_id").orderBy(F.col("fused_score").desc(), "chunk_id"))).drop("r", "n", "quota")


def select_candidates(ranked: DataFrame, limit: int = 50, top_n: int | None = None, least_units: int = 20) -> DataFrame:
    """The first rows by position: limit of them, or (with top_n, for parent/child chunks) until enough distinct units came.

    Enough: max(3 * top_n, least_units) units; a unit is parent_id, else the chunk.
    """
    kept = ranked.filter(F.col("position") <= limit)
    if top_n is None:
        return kept
    enough = max(3 * top_n, least_units)
    unit = F.coalesce("parent_id", "chunk_id")
    order = _over("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    first = kept.withColumn("unit", unit).withColumn("new", (F.row_number().over(_over("query_id", "unit").orderBy("position")) == 1).cast("int"))
    return first.withColumn("before", F.coalesce(F.sum("new").over(order), F.lit(0))).filter(F.col("before") < enough).drop("new", "before", "unit")


def hybrid_order(candidates: DataFrame, w: float = 0.7, rest: float | None = None) -> DataFrame:
    """hybrid_score = w * rerank_score + rest * min-max of bm25_score (null counts 0; equal scores become 0). rest: 1 - w, unless given as the number that a decimal stands for."""
    filled = candidates.withColumn("__b", F.coalesce("bm25_score", F.lit(0.0)))
    return filled.withColumn("hybrid_score", w * F.col("rerank_score") + (1 - w if rest is None else rest) * minmax(F.col("__b"), _over("query_id"), 0.0)).drop("__b")


def ordering_score() -> Column:
    """The score that candidates are ordered by: hybrid, else rerank, else fused."""
    return F.coalesce("hybrid_score", "rerank_score", "fused_score")


def merge_parents(candidates: DataFrame, score: str = "ordering_score", first: str = "chunk_id") -> DataFrame:
    """Chunks grouped to units (parent_id, else the chunk): unit_id, unit_score (the best), members best first, best, position.

    first: the column that says which of several chunks of the best score is best: the one with the least.
    """
    member = F.struct((-F.col(score)).alias("minus"), "chunk_id", F.col(score).alias("score"))
    best = F.min_by("chunk_id", F.struct(-F.col(score), first)).alias("best")
    units = candidates.groupBy("query_id", F.coalesce("parent_id", "chunk_id").alias("unit_id")).agg(F.max(score).alias("unit_score"), F.array_sort(F.collect_list(member)).alias("m"), best)
    units = units.withColumn("members", F.transform("m", lambda x: x["chunk_id"])).drop("m")
    return units.withColumn("position", F.row_number().over(_over("query_id").orderBy(F.col("unit_score").desc(), "unit_id")))


def threshold_target(rerank_applied: bool, vector_ran: bool) -> str:
    return "RERANK" if rerank_applied else "COSINE" if vector_ran else "NONE"


def apply_threshold(units: DataFrame, threshold: float | None, target: str) -> DataFrame:
    """Units whose best member's target score is at least threshold; a missing score fails. Inactive without a threshold or target."""
    if threshold is None or target == "NONE":
        return units
    return units.filter(F.col({"RERANK": "rerank_score", "COSINE": "vector_score"}[target]) >= threshold)


def reported_score(target: str, fusion: str, threshold_active: bool = False, many_kbs: bool = False) -> tuple[Column, str]:
    """(score, score_type) shown for a unit."""
    if target == "RERANK":
        return F.col("rerank_score"), "rerank"
    if threshold_active and target == "COSINE":
        return F.coalesce("vector_score", F.lit(0.0)), "vector"
    if threshold_active and target == "NONE":
        return F.coalesce("bm25_score", F.lit(0.0)), "bm25"
    return F.col("fused_score"), "fused_rrf" if many_kbs or fusion == "RRF" else "fused_weighted"


def top_n(units: DataFrame, n: int | None, default: int = 5, most: int = 20) -> DataFrame:
    """The first n units of each query (default if not positive, most at most)."""
    n = default if n is None or n <= 0 else min(n, most)
    return units.filter(F.col("position") <= n)


def content_budget(units: DataFrame, budget: int | None, length: Column) -> DataFrame:
    """The longest prefix by position whose lengths sum to budget at most, and the first unit in any case; all without a positive budget.

    A null length counts 0.
    """
    if budget is None or budget <= 0:
        return units
    length = F.coalesce(length, F.lit(0))
    order = _over("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = units.withColumns({"__sum": F.sum(length).over(order), "__first": F.min("position").over(_over("query_id"))})
    return summed.filter((F.col("__sum") <= budget) | (F.col("position") == F.col("__first"))).drop("__sum", "__first")


def degradation_markers(*markers: Column) -> Column:
    """Distinct reason codes in the order given, nulls left out."""
    return F.array_distinct(F.array_compact(F.array(*markers)))


def lexical_rerank(candidates: DataFrame) -> DataFrame:
    """A deterministic stand-in for a rerank model: the share of the query's distinct tokens that text has."""
    from lexlake.operators.recall import tokens

    asked = F.array_distinct(tokens(F.col("query")))
    return candidates.withColumn("rerank_score", F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(F.col("text")))) / F.size(asked)).otherwise(0.0))


def graph_relevance(rows: DataFrame, limit: int = 50, names: int = 5) -> DataFrame:
    """Chunks from graph traces (query_id, chunk_id, entity_name, match_score, hops): relevance match / (1 + hops), the best per chunk.

    hops of the first best row; up to five distinct entity names, best first.
    """
    scored = rows.withColumn("rel", F.col("match_score") / (1 + F.col("hops")))
    one = scored.groupBy("query_id", "chunk_id", "entity_name").agg(F.max("rel").alias("rel"), F.max_by("hops", F.struct("rel", -F.col("hops"))).alias("hops"))
    best = one.groupBy("query_id", "chunk_id").agg(
        F.max("rel").alias("score"), F.max_by("hops", F.struct("rel", -F.col("hops"))).alias("hops"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rel")).alias("m"), "entity_name"))), lambda x: x["entity_name"]), 1, names).alias("entities"),
    )
    return best.withColumn("position", F.row_number().over(_over("query_id").orderBy(F.col("score").desc(), "chunk_id"))).filter(F.col("position") <= limit)
