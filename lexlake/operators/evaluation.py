"""Offline evaluation of retrieval and answers, and release gates."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Quantile of the normal distribution for a 95 % interval.
Z = 1.959963985
SLACK = 1e-9


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share; 0 and 0 for n = 0."""
    p, z2 = hits / n, Z * Z
    middle, spread = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = ((middle + s * spread) / (1 + z2 / n) for s in (-1, 1))
    return F.when(n > 0, F.greatest(low, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(high, F.lit(1.0))).otherwise(0.0)


def ndcg(relevance: Column, ideal: Column, k: int) -> Column:
    """Gain of the first k flags by 1 / log2(position + 1), over that of min(max(ideal, flags set), k) set ones."""
    gain = lambda flags: F.aggregate(F.transform(flags, lambda x, i: F.when(x, 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    top = F.slice(relevance, 1, k)
    best = F.least(F.greatest(ideal, F.size(F.filter(top, lambda x: x))), F.lit(k))
    ideal_gain = F.when(best > 0, gain(F.transform(F.sequence(F.lit(1), F.greatest(best, F.lit(1))), lambda i: F.lit(True)))).otherwise(0.0)
    return F.when(ideal_gain > 0, gain(top) / ideal_gain).otherwise(0.0)


def retrieval_metrics(cases: DataFrame, k: int, *by: str) -> DataFrame:
    """Per group of judged cases (hit, hit_rank, evidence_hits, evidence_total, relevance, ideal_relevant).

    recall: mean of each case's share of evidence; precision: relevant ones over k, whatever was returned; hit_rate, mrr, ndcg;
    95 % intervals of the pooled evidence share and of the hit rate.
    """
    one = F.lit(1)
    recall = F.avg(F.when(F.col("evidence_total") > 0, F.col("evidence_hits") / F.col("evidence_total")).otherwise(0.0))
    relevant = F.size(F.filter(F.slice("relevance", 1, k), lambda x: x))
    sums = cases.groupBy(*by).agg(
        F.count(one).alias("cases"), recall.alias("recall"), F.avg(relevant / F.lit(float(k))).alias("precision"), F.avg(F.col("hit").cast("double")).alias("hit_rate"),
        F.avg(F.when(F.col("hit") & (F.col("hit_rank") > 0), 1.0 / F.col("hit_rank")).otherwise(0.0)).alias("mrr"), F.avg(ndcg(F.col("relevance"), F.col("ideal_relevant"), k)).alias("ndcg"),
        F.sum("evidence_hits").alias("__eh"), F.sum("evidence_total").alias("__et"), F.count_if("hit").alias("__h"),
    )
    pooled, hits = wilson(F.col("__eh"), F.col("__et")), wilson(F.col("__h"), F.col("cases"))
    names = {"recall_low": pooled[0], "recall_high": pooled[1], "hit_low": hits[0], "hit_high": hits[1]}
    return sums.withColumns(names).drop("__eh", "__et", "__h")


def metric_groups(cases: DataFrame) -> DataFrame:
    """A row for each group that a case is in: overall, its anchor (span or document), single_turn or multi_turn."""
    groups = F.array(F.lit("overall"), F.lower("anchor_type"), F.when(F.col("turns") > 1, "multi_turn").otherwise("single_turn"))
    return cases.withColumn("group", F.explode(groups))


def answer_metrics(cases: DataFrame, *by: str) -> DataFrame:
    """Means of judged answers, refusal accuracy, failures (requested but not judged) and the nearest-rank 95th percentile of latency."""
    judged = F.col("score").isNotNull()
    means = [F.avg(c).alias(f"avg_{c}") for c in ("score", "correctness", "faithfulness", "completeness")]
    return cases.groupBy(*by).agg(
        F.count_if("requested").alias("requested"), F.count_if(judged).alias("judged"), *means, F.avg(F.col("refusal_correct").cast("double")).alias("refusal_accuracy"),
        (F.count_if("requested") - F.count_if(F.col("requested") & judged)).alias("failed"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_latency_ms"),
    )


def judge_score(a: Column, b: Column, c: Column) -> Column:
    """Rounded mean of three marks, within 1..5."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.round((a + b + c) / 3).cast("int")))


def judge_documents(evidence: DataFrame, ranked: DataFrame) -> DataFrame:
    """Per case: evidence documents found, of how many, and the first rank that has one. evidence (case_id, doc_id), ranked (case_id, rank, doc_id)."""
    first = ranked.groupBy("case_id", "doc_id").agg(F.min("rank").alias("rank"))
    found = evidence.select("case_id", "doc_id").distinct().join(first, ["case_id", "doc_id"], "left")
    return found.groupBy("case_id").agg(F.count("rank").alias("evidence_hits"), F.count(F.lit(1)).alias("evidence_total"), F.min("rank").alias("hit_rank")).withColumn("hit", F.col("hit_rank").isNotNull())


def longest_run(text: str, span: str) -> tuple[int, int]:
    """(start in span, length) of the longest string that both hold; of equal ones the first in span. Memory is one row of a table."""
    letters, best, at = np.frombuffer(text.encode("utf-32-le"), np.uint32), 0, 0
    row = np.zeros(len(letters) + 1, np.int32)
    for i, c in enumerate(span):
        row[1:] = np.where(letters == ord(c), row[:-1] + 1, 0)
        if (n := int(row.max())) > best:
            best, at = n, i - n + 1
    return at, best


def _bare(text: str | None) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKC", text or "") if not c.isspace() and c != "*")


def overlap_ratio(text: Column, span: Column) -> Column:
    """Longest common string over the span's length, both normalised (NFKC, no white space, no mask)."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            pairs = [(_bare(x), _bare(y)) for x, y in zip(a, b, strict=True)]
            yield pd.Series([min(1.0, longest_run(x, y)[1] / len(y)) if y else 0.0 for x, y in pairs], dtype=float)

    return ratio(text, span)


def common_run(text: Column, span: Column) -> Column:
    """Struct (start, length, span): where in the normalised span its longest string lies that the text holds, how long it is, and how long the span."""

    @F.pandas_udf("struct<start: int, length: int, span: int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            bare = [(_bare(x), _bare(y)) for x, y in zip(a, b, strict=True)]
            found = [(*longest_run(x, y), len(y)) for x, y in bare]
            yield pd.DataFrame(found, columns=["start", "length", "span"], dtype="int32")

    return run(text, span)


def covered(runs: list[tuple[int, int]]) -> int:
    """Length of the union of (start, length) intervals."""
    total = end = 0
    for a, n in sorted(runs):
        total += max(0, a + n - max(a, end))
        end = max(end, a + n)
    return total


def judge_spans(evidence: DataFrame, ranked: DataFrame, least: float = 0.5) -> DataFrame:
    """Per evidence span (case_id, evidence_no, doc_id, span): hit_rank, the first rank at which the texts so far of its document cover
    least of it, and coverage at the end. ranked (case_id, rank, doc_id, text).

    One longest run of each text counts; overlaps count once. Only texts of the evidence's own document meet it, so a
    group is one span and its few ranked texts.
    """
    pairs = evidence.join(ranked, ["case_id", "doc_id"], "left").select("case_id", "evidence_no", "span", "rank", "text")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        span, runs, hit, share = _bare(pdf["span"].iloc[0]), [], None, 0.0
        for rank, text in zip(pdf["rank"], pdf["text"], strict=True):
            if pd.isna(rank):
                continue
            runs.append(longest_run(_bare(text), span))
            share = min(1.0, covered(runs) / len(span)) if span else 0.0
            if hit is None and share >= least:
                hit = int(rank)
        return pd.DataFrame({"case_id": [pdf["case_id"].iloc[0]], "evidence_no": [pdf["evidence_no"].iloc[0]], "hit_rank": pd.array([hit], "Int64"), "coverage": [share]})

    kind = evidence.schema["case_id"].dataType.simpleString()
    number = evidence.schema["evidence_no"].dataType.simpleString()
    return pairs.groupBy("case_id", "evidence_no").applyInPandas(judge, f"case_id {kind}, evidence_no {number}, hit_rank bigint, coverage double")


def common_cases(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cases that both runs have; of repeated ones the first (by seq)."""

    def one(run: DataFrame, side: str) -> DataFrame:
        rest = [c for c in run.columns if c not in ("case_id", "seq")]
        best = run.groupBy("case_id").agg(F.min_by(F.struct(*rest), "seq").alias(side))
        return best

    return one(candidate, "c").join(one(baseline, "b"), "case_id")


def gate_metrics(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Hit rates and mean recalls of both runs on their common cases, and degraded cases of either."""
    both = common_cases(candidate, baseline)
    recall = lambda s: F.avg(F.when(F.col(f"{s}.evidence_total") > 0, F.col(f"{s}.evidence_hits") / F.col(f"{s}.evidence_total")).otherwise(0.0))
    return both.agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.col("c.hit").cast("double")).alias("hit_rate"), F.avg(F.col("b.hit").cast("double")).alias("base_hit_rate"),
        recall("c").alias("recall"), recall("b").alias("base_recall"), F.count_if(F.col("c.degraded") | F.col("b.degraded")).alias("degraded"),
    )


def epsilon(points: Column, n: Column) -> Column:
    """Tolerated loss: so many percentage points, one case at least."""
    return F.greatest(points / 100, 1 / n)


def release_gate(m: DataFrame, points: float = 2.0, least_cases: int = 50, most_stale: float = 0.15) -> DataFrame:
    """Verdict and reason for rows of gate_metrics with has_dataset, run_ok, comparable, stale_rate, has_baseline, min_hit_rate, min_recall.

    LOG_ONLY where the numbers can't be trusted; else PASSED or BLOCKED against the baseline within epsilon. A first release is held
    to the thresholds that are set (null: not); without any its run is recorded as the baseline and it passes.
    """
    eps = epsilon(F.lit(points), F.col("cases"))
    worse = (F.col("hit_rate") - F.col("base_hit_rate") < -eps - SLACK) | (F.col("recall") - F.col("base_recall") < -eps - SLACK)
    unset = F.col("min_hit_rate").isNull() & F.col("min_recall").isNull()
    below = F.coalesce(F.col("hit_rate") < F.col("min_hit_rate"), F.lit(False)) | F.coalesce(F.col("recall") < F.col("min_recall"), F.lit(False))
    reason = (
        F.when(~F.col("has_dataset"), "NO_DATASET").when(~F.col("run_ok"), "RUN_FAILED").when(~F.col("comparable"), "NOT_COMPARABLE").when(F.col("cases") < least_cases, "INSUFFICIENT_CASES")
        .when(F.col("stale_rate") > most_stale, "STALE_RATIO_EXCEEDED").when(F.col("degraded") > 0, "DEGRADED_CASES")
        .when(~F.col("has_baseline") & unset, "BASELINE_RECORDED").when(~F.col("has_baseline") & below, "ABSOLUTE_THRESHOLD_NOT_MET").when(~F.col("has_baseline"), "ABSOLUTE_THRESHOLD_MET")
        .when(worse, "METRICS_REGRESSED").otherwise("WITHIN_TOLERANCE")
    )
    decision = F.when(F.col("reason").isin("ABSOLUTE_THRESHOLD_NOT_MET", "METRICS_REGRESSED"), "BLOCKED").when(F.col("reason").isin("BASELINE_RECORDED", "ABSOLUTE_THRESHOLD_MET", "WITHIN_TOLERANCE"), "PASSED").otherwise("LOG_ONLY")
    return m.withColumn("reason", reason).withColumn("decision", decision)


#: What answers are marked by, and what a gate compares of it beside refusals. Fixed values.
ANSWER_MARKS = ("score", "correctness", "faithfulness", "completeness", "citation_correctness", "citation_completeness")
#: Marks that a first release may be held to, as min_ columns. Fixed values.
HELD_TO = ("score", "faithfulness", "citation_correctness", "refusal_accuracy")


def answer_comparison(candidate: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """One row: means of both runs' answers over the cases that count, how many (cases), judgements that failed, degraded cases, has_baseline.

    Runs have (case_id, seq, requested, judged, degraded, refusal_correct) and ANSWER_MARKS. Of a run's requested answers the first of
    a case (by seq) counts. With a baseline those cases count that both runs judged, and a case that both asked for and either
    failed to judge is a failure; without one (None, or a run without rows) the candidate's own. A null mark counts 0, a null
    refusal_correct as wrong; without cases all means are 0. Base means are null without a baseline.
    """
    marks = [F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in ANSWER_MARKS]
    slim = F.struct(*marks, F.coalesce(F.col("refusal_correct"), F.lit(False)).cast("double").alias("refusal_accuracy"), F.coalesce("judged", F.lit(False)).alias("judged"), F.coalesce("degraded", F.lit(False)).alias("degraded"))

    def first(run: DataFrame, side: str) -> DataFrame:
        return run.filter("requested AND case_id IS NOT NULL").groupBy("case_id").agg(F.min_by(slim, "seq").alias(side))

    compared = baseline is not None and not baseline.isEmpty()
    both = first(candidate, "c").join(first(baseline, "b"), "case_id") if compared else first(candidate, "c")
    sides = ("c", "b") if compared else ("c",)
    counts = functools.reduce(lambda x, y: x & y, (F.col(f"{x}.judged") for x in sides))
    # Without a baseline all requested cases are looked at for degradation, judged or not.
    bad = functools.reduce(lambda x, y: x | y, (F.col(f"{x}.degraded") for x in sides))
    mean = lambda x, m: F.coalesce(F.avg(F.when(counts, F.col(f"{x}.{m}"))), F.lit(0.0))
    names = (*ANSWER_MARKS, "refusal_accuracy")
    base = [mean("b", m).alias(f"base_{m}") if compared else F.max(F.lit(None).cast("double")).alias(f"base_{m}") for m in names]
    return both.agg(*(mean("c", m).alias(m) for m in names), *base, F.count_if(counts).alias("cases"), F.count_if(~counts).alias("failed"), F.count_if(bad & counts if compared else bad).alias("degraded"), F.lit(compared).alias("has_baseline"))


def answer_gate(m: DataFrame, least_cases: int = 50, score_loss: float = 0.2, points: float = 5.0) -> DataFrame:
    """Decision and reason for rows of answer_comparison with available (whether answers were judged at all) and min_ columns of HELD_TO (null: not held).

    LOG_ONLY where the numbers can't be trusted; else PASSED or BLOCKED: against a baseline no mark may lose more than score_loss, nor
    refusal accuracy more than points of a hundred or one case; a first release is held to the thresholds that are set, and without
    any becomes the baseline.
    """
    worse = functools.reduce(lambda x, y: x | y, (F.col(x) - F.col(f"base_{x}") < -max(0.0, score_loss) - SLACK for x in ANSWER_MARKS))
    worse = F.coalesce(worse | (F.col("refusal_accuracy") - F.col("base_refusal_accuracy") < -epsilon(F.lit(points), F.col("cases")) - SLACK), F.lit(False))
    unset = functools.reduce(lambda x, y: x & y, (F.col(f"min_{x}").isNull() for x in HELD_TO))
    below = functools.reduce(lambda x, y: x | y, (F.coalesce(F.col(x) + SLACK < F.col(f"min_{x}"), F.lit(False)) for x in HELD_TO))
    reason = (
        F.when(~F.col("available"), "ANSWER_EVAL_UNAVAILABLE").when(F.col("failed") > 0, "ANSWER_JUDGE_FAILED").when(F.col("cases") < least_cases, "ANSWER_INSUFFICIENT_CASES").when(F.col("degraded") > 0, "DEGRADED_CASES")
        .when(~F.col("has_baseline") & unset, "ANSWER_BASELINE_RECORDED").when(~F.col("has_baseline") & below, "ANSWER_ABSOLUTE_THRESHOLD_NOT_MET").when(~F.col("has_baseline"), "ANSWER_ABSOLUTE_THRESHOLD_MET")
        .when(worse, "ANSWER_METRICS_REGRESSED").otherwise("ANSWER_WITHIN_TOLERANCE")
    )
    blocked = F.col("reason").isin("ANSWER_ABSOLUTE_THRESHOLD_NOT_MET", "ANSWER_METRICS_REGRESSED")
    passed = F.col("reason").isin("ANSWER_BASELINE_RECORDED", "ANSWER_ABSOLUTE_THRESHOLD_MET", "ANSWER_WITHIN_TOLERANCE")
    return m.withColumn("reason", reason).withColumn("decision", F.when(blocked, "BLOCKED").when(passed, "PASSED").otherwise("LOG_ONLY"))


def comparable(runs: DataFrame, *by: str) -> DataFrame:
    """Whether all runs (of a group) share dataset revision, corpus fingerprint, judge and mode."""
    keys = ("dataset_revision", "corpus_fingerprint", "judge_model", "answer_enabled")
    counts = runs.groupBy(*by).agg(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"__{c}") for c in keys))
    return counts.select(*by, (sum((F.col(f"__{c}") for c in keys), F.lit(0)) == len(keys)).alias("comparable"))


def call_estimate(cases: DataFrame, configs: DataFrame) -> DataFrame:
    """Model calls of a run by configuration: embeddings, reranks, rewrites of multi-turn cases, answers and their judgements."""
    n, multi = F.count(F.lit(1)), F.count_if(F.col("turns") > 1)
    sums = cases.agg(n.alias("n"), multi.alias("multi"))
    when = lambda flag, x: F.when(F.col(flag), F.col(x)).otherwise(0)
    return configs.join(F.broadcast(sums)).select("config_id", when("vector", "n").alias("embeddings"), when("rerank", "n").alias("reranks"), when("rewrite", "multi").alias("rewrites"), (2 * when("answers", "n")).alias("answer_calls"))


def corpus_fingerprint(versions: DataFrame, model: str, etags: list[str]) -> DataFrame:
    """One row: SHA-256 over the sorted distinct version ids, the embedding model and dictionary tags.

    Ids are made distinct by all tasks; one then sorts them (spilling as it must) and hashes them as they pass, holding none: a
    hash has one order. The ids of a knowledge base's versions, not its texts, form the hashed line.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, first = hashlib.sha256(), True
        for batch in batches:
            for x in batch.column(0).to_pylist():
                line.update(("" if first else ",").encode() + x.encode())
                first = False
        line.update("|".join(["", model, *sorted(etags)]).encode())
        yield pa.RecordBatch.from_arrays([pa.array([line.hexdigest()])], names=["fingerprint"])

    ids = versions.filter("version_id IS NOT NULL").select(F.col("version_id").cast("string").alias("version_id")).distinct()
    return ids.repartition(1).sortWithinPartitions("version_id").mapInArrow(digest, "fingerprint string")


def feedback_cases(feedback: DataFrame, chunks: DataFrame, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """(cases with their evidence, feedback after it) of feedback (feedback_id, status, verdict, query, chunk_id) and chunks (chunk_id, doc_id, content, chunk_type).

    New feedback that isn't BAD becomes a case of its query, if its chunk is there: anchored to the chunk's document for an image, else
    to its text. status becomes CONVERTED with the case's id; refused says why else: NOT_NEW, BAD, or NO_CHUNK. A case's id follows
    from the feedback's, so a second attempt makes no second case.
    """
    known = chunks.select("chunk_id", "doc_id", "content", "chunk_type", F.lit(True).alias("__there")).dropDuplicates(["chunk_id"])
    both = feedback.join(known, "chunk_id", "left")
    refused = F.when(~F.coalesce(F.col("status") == "NEW", F.lit(False)), "NOT_NEW").when(F.coalesce(F.col("verdict") == "BAD", F.lit(False)), "BAD").when(F.col("__there").isNull(), "NO_CHUNK")
    judged = both.withColumn("refused", refused).withColumn("case_id", F.when(F.col("refused").isNull(), F.concat(F.lit("case_"), F.substring(F.sha2(F.concat_ws("|", F.lit(dataset_id), F.col("feedback_id").cast("string")), 256), 1, 24))))
    anchor = F.when(F.col("chunk_type") == "IMAGE", "DOCUMENT").otherwise("SPAN")
    cases = judged.filter("case_id IS NOT NULL").select("case_id", F.lit(dataset_id).alias("dataset_id"), "query", anchor.alias("anchor_type"), "doc_id", F.when(anchor == "SPAN", F.col("content")).alias("span"), F.lit("FEEDBACK").alias("source"))
    return cases, judged.select("feedback_id", F.when(F.col("case_id").isNotNull(), "CONVERTED").otherwise(F.col("status")).alias("status"), "case_id", "refused")


def evidence_coverage(evidence: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """The most chunks of an evidence's document and version that cover its span best.

    evidence (case_id, evidence_no, doc_id, version_id, span), chunks (doc_id, version_id, chunk_id, content); ratio as overlap_ratio.
    """
    pairs = evidence.join(chunks, ["doc_id", "version_id"]).withColumn("ratio", overlap_ratio(F.col("content"), F.col("span")))
    order = W.partitionBy("case_id", "evidence_no").orderBy(F.col("ratio").desc(), "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("case_id", "evidence_no", "doc_id", "chunk_id", "ratio", "rank")


def stale_cases(cases: DataFrame, evidence: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """Active cases with spans (case_id, anchor_type, status) of which some evidence is covered less than least by the target version's chunks."""
    best = evidence_coverage(evidence, chunks, 1).select("case_id", "evidence_no", "ratio")
    lacking = evidence.join(best, ["case_id", "evidence_no"], "left").filter(F.coalesce("ratio", F.lit(0.0)) < least).select("case_id").distinct()
    return cases.filter("anchor_type = 'SPAN' AND status = 'ACTIVE'").join(lacking, "case_id", "left_semi")


def activation_impact(annotations: DataFrame, chunks: DataFrame, stale: DataFrame) -> DataFrame:
    """One row: annotations (annotation_id, text_hash) without a chunk of that text in the new version, and cases that become stale."""
    lost = annotations.join(chunks.select("text_hash").distinct(), "text_hash", "left_anti").agg(F.count(F.lit(1)).alias("stale_annotations"))
    return lost.join(F.broadcast(stale.agg(F.count(F.lit(1)).alias("affected_cases"))))
