"""Evaluation runs: all cases in several modes from one recall, retried while degraded, and judged."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.operators import evaluation as ev
from lexlake.operators import fusion, recall
from lexlake.storage import materialize

#: Routes of each mode, and whether it reranks. Fixed values.
MODES = {"BM25_ONLY": (("BM25",), False), "VECTOR_ONLY": (("VECTOR",), False), "HYBRID": (("VECTOR", "BM25"), False), "HYBRID_RERANK": (("VECTOR", "BM25"), True)}
#: What an outcome is marked with when a service that its mode uses is out. Fixed values.
MARKERS = {"VECTOR": "vector_route_unavailable", "RERANK": "rerank_unavailable"}
#: Times that a degraded search is repeated at most.
RETRIES = 2


def recall_cases(cases: DataFrame, chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(case_id, route, chunk_id, score): the k best of both routes for all cases, stored; every mode and retry reads them.

    cases (case_id, query), chunks (chunk_id, text), vectors (chunk_id, vector), queries (case_id, vector). Texts and vectors are
    scanned once, however many cases and modes there are. A case without a vector has no rows of that route.
    """
    words = recall.bm25(chunks, cases.select(F.col("case_id").alias("query_id"), F.col("query").alias("text")), k).withColumn("route", F.lit("BM25"))
    near = recall.vector_search(vectors, queries.select(F.col("case_id").alias("query_id"), "vector"), k).withColumn("route", F.lit("VECTOR"))
    return materialize(words.unionByName(near).select(F.col("query_id").alias("case_id"), "route", "chunk_id", "score"), "routes")


def ask(cases: DataFrame, modes: tuple[str, ...] = tuple(MODES)) -> DataFrame:
    """(case_id, mode) of active cases."""
    unknown = set(modes) - set(MODES)
    if unknown:
        raise ValueError(f"unknown modes {sorted(unknown)}")
    return cases.select("case_id", F.explode(F.array(*map(F.lit, modes))).alias("mode"))


def _services(spark) -> DataFrame:
    """(mode, service, is_route): a few rows."""
    rows = [(m, s, s != "RERANK") for m, (routes, rerank) in MODES.items() for s in (*routes, *(["RERANK"] if rerank else []))]
    return F.broadcast(spark.createDataFrame(rows, "mode string, service string, is_route boolean"))


def search_modes(asked: DataFrame, routes: DataFrame, reranked: DataFrame, outages: DataFrame, top_n: int = 5, limit: int = 50, w: float = 0.7) -> DataFrame:
    """Per asked (case_id, mode): degraded (markers, sorted) and hits (rank, chunk_id, score; best first).

    routes as of recall_cases; reranked (case_id, chunk_id, rerank_score); outages (case_id, service): services that don't answer
    for a case, of which MARKERS says how an outcome is marked. Routes that answer are fused by reciprocal ranks; in
    a mode that reranks, the first limit are ordered by hybrid score, or as fused where the reranker is out.
    """
    used = asked.join(_services(asked.sparkSession), "mode")
    out = outages.select("case_id", "service").distinct()
    rows = used.filter("is_route").join(out, ["case_id", "service"], "left_anti").join(routes.withColumnRenamed("route", "service"), ["case_id", "service"])
    fused = fusion.rrf(rows.select(F.struct("case_id", "mode").alias("query_id"), F.col("service").alias("route"), "chunk_id", "score"))
    first = fused.filter(F.col("position") <= limit).select("query_id", "query_id.case_id", "query_id.mode", "chunk_id", "fused_score", F.col("route_scores")["BM25"].alias("bm25_score"))
    reranks = [m for m, (_, rerank) in MODES.items() if rerank]
    dead = out.filter("service = 'RERANK'").select("case_id", F.lit(True).alias("dead"))
    marked = first.join(reranked, ["case_id", "chunk_id"], "left").join(dead, "case_id", "left")
    usable = F.col("mode").isin(reranks) & F.col("dead").isNull()
    ordered = fusion.hybrid_order(marked.withColumn("rerank_score", F.when(usable, F.col("rerank_score"))), w).withColumn("score", F.coalesce("hybrid_score", "fused_score"))
    # Those that the reranker left out come after those that it scored.
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("hybrid_score").isNull(), F.col("score").desc(), "chunk_id"))
    best = ordered.withColumn("rank", place).filter(F.col("rank") <= top_n)
    hits = best.groupBy("case_id", "mode").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("hits"))
    marker = F.create_map(*(F.lit(x) for pair in MARKERS.items() for x in pair))[F.col("service")]
    bad = used.join(out, ["case_id", "service"]).groupBy("case_id", "mode").agg(F.sort_array(F.collect_set(marker)).alias("degraded"))
    found = asked.join(hits, ["case_id", "mode"], "left").join(bad, ["case_id", "mode"], "left")
    none = F.array().cast(dict(hits.dtypes)["hits"])
    return found.select("case_id", "mode", F.coalesce("degraded", F.array().cast("array<string>")).alias("degraded"), F.coalesce("hits", none).alias("hits"))


def retried(asked: DataFrame, search: Callable[[DataFrame, int], DataFrame], retries: int = RETRIES) -> DataFrame:
    """The last outcome of all that is asked, with retries: how often it was asked again.

    search takes what is asked and the number of the attempt and gives its columns, degraded, and more. A round asks
    again only what was degraded in the one before; its outcomes are stored, so a lost executor costs one round at most.
    """
    todo, done = asked, None
    for attempt in range(retries + 1):
        found = materialize(search(todo, attempt).withColumn("retries", F.lit(attempt)), "outcomes")
        bad = found.filter(F.size("degraded") > 0)
        last = attempt == retries or bad.isEmpty()
        settled = found if last else found.filter(F.size("degraded") == 0)
        done = settled if done is None else done.unionByName(settled)
        if last:
            return done
        todo = bad.select(*asked.columns)
    return done


def evaluation_run(cases: DataFrame, routes: DataFrame, reranked: DataFrame, outages: DataFrame, modes: tuple[str, ...] = tuple(MODES), top_n: int = 5, retries: int = RETRIES) -> DataFrame:
    """Per case and mode: degraded, hits, retries. outages (case_id, attempt, service): what did not answer at which attempt, from 0."""
    search = lambda todo, n: search_modes(todo, routes, reranked, outages.filter(F.col("attempt") == n), top_n)
    return retried(ask(cases, modes), search, retries)


def ranked_hits(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("case_id", "mode", F.explode("hits").alias("h")).select("case_id", "mode", "h.rank", "h.chunk_id")


def _flags(top_n: int) -> Column:
    """Relevance by rank from a group's rows (rank, relevant)."""
    at = F.collect_set(F.when(F.col("relevant"), F.col("rank")))
    return F.transform(F.sequence(F.lit(1), F.lit(top_n)), lambda i: F.array_contains(at, i)).alias("relevance")


def judge_document_cases(outcomes: DataFrame, evidence: DataFrame, chunks: DataFrame, top_n: int = 5) -> DataFrame:
    """Per case and mode: hit, hit_rank, evidence_hits, evidence_total, relevance by rank, ideal_relevant; as retrieval_metrics takes them.

    evidence (case_id, doc_id): documents that should be found; chunks (chunk_id, doc_id). Cases without evidence are left out.
    """
    wanted = evidence.select("case_id", "doc_id").distinct()
    ranked = ranked_hits(outcomes).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    every = outcomes.select("case_id", "mode").join(wanted, "case_id")
    case = F.struct("case_id", "mode").alias("case_id")
    judged = ev.judge_documents(every.select(case, "doc_id"), ranked.select(case, "rank", "doc_id")).select("case_id.*", "hit", "hit_rank", "evidence_hits", "evidence_total")
    seen = ranked.join(wanted.withColumn("relevant", F.lit(True)), ["case_id", "doc_id"], "left").groupBy("case_id", "mode").agg(_flags(top_n))
    return judged.join(seen, ["case_id", "mode"], "left").withColumn("relevance", F.coalesce("relevance", F.array_repeat(F.lit(False), top_n))).withColumn("ideal_relevant", F.col("evidence_total"))


def judge_span_cases(outcomes: DataFrame, evidence: DataFrame, chunks: DataFrame, top_n: int = 5, least: float = 0.5) -> DataFrame:
    """As judge_document_cases, for evidence (case_id, evidence_no, span) and chunks (chunk_id, text).

    A span is hit at the first rank where the texts so far cover least of it (one longest run of each text; overlaps count
    once); a rank is relevant if its text shares anything with a span. Texts are compared with spans once, whatever modes found them.
    """
    ranked = ranked_hits(outcomes)
    pairs = ranked.select("case_id", "chunk_id").distinct().join(evidence, "case_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    runs = materialize(pairs.select("case_id", "evidence_no", "chunk_id", ev.common_run(F.col("text"), F.col("span")).alias("run")).select("case_id", "evidence_no", "chunk_id", "run.*"), "runs")
    every = outcomes.select("case_id", "mode").join(evidence.select("case_id", "evidence_no"), "case_id")
    met = every.join(ranked.join(runs, ["case_id", "chunk_id"]), ["case_id", "mode", "evidence_no"], "left").select("case_id", "mode", "evidence_no", "rank", "start", "length", "span")

    @F.pandas_udf("bigint")
    def first_hit(spans: pd.Series) -> pd.Series:
        """The first rank at which the runs so far cover least of the span; runs ordered by rank."""

        def judge(found: Iterable[dict]) -> int | None:
            held = []
            for x in found:
                held.append((x["start"], x["length"]))
                if x["span"] and min(1.0, ev.covered(held) / x["span"]) >= least:
                    return x["rank"]
            return None

        return pd.Series([judge(x) for x in spans], dtype="Int64")

    # A span's runs are at most top_n short rows.
    own = F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "start", "length", "span"))))
    spans = met.groupBy("case_id", "mode", "evidence_no").agg(own.alias("found")).select("case_id", "mode", first_hit("found").alias("hit_rank"))
    cases = spans.groupBy("case_id", "mode").agg(F.min("hit_rank").isNotNull().alias("hit"), F.min("hit_rank").alias("hit_rank"), F.count("hit_rank").alias("evidence_hits"), F.count(F.lit(1)).alias("evidence_total"))
    seen = ranked.join(runs.groupBy("case_id", "chunk_id").agg((F.max("length") > 0).alias("relevant")), ["case_id", "chunk_id"], "left").groupBy("case_id", "mode").agg(_flags(top_n))
    return cases.join(seen, ["case_id", "mode"], "left").withColumn("relevance", F.coalesce("relevance", F.array_repeat(F.lit(False), top_n))).withColumn("ideal_relevant", F.col("evidence_total"))
