"""Evaluation runs: modes, retries and judgements against plain versions."""

import math
import random

import pytest

from lexlake.operators import evaluation as ev
from lexlake.operators import recall, runs


def test_modes_retry_and_mark(spark):
    cases = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "case_id long, query string")
    routes = spark.createDataFrame([(c, r, x, s) for c in (1, 2, 3) for r, x, s in (("BM25", 10, 3.0), ("BM25", 11, 2.0), ("VECTOR", 12, 0.9), ("VECTOR", 11, 0.8))], "case_id long, route string, chunk_id long, score double")
    reranked = spark.createDataFrame([(c, x, s) for c in (1, 2, 3) for x, s in ((10, 0.1), (11, 0.2), (12, 0.9))], "case_id long, chunk_id long, rerank_score double")
    outages = spark.createDataFrame([(2, 0, "VECTOR"), (3, 0, "RERANK"), (3, 1, "RERANK"), (3, 2, "RERANK"), (3, 0, "VECTOR")], "case_id long, attempt int, service string")
    asked = []
    search = runs.search_modes

    def counted(todo, *rest):
        asked.append(todo.count())
        return search(todo, *rest)

    runs.search_modes = counted
    try:
        got = {(r.case_id, r["mode"]): r for r in runs.evaluation_run(cases, routes, reranked, outages, top_n=2).collect()}
    finally:
        runs.search_modes = search
    ids = lambda k: [h.chunk_id for h in got[k].hits]
    assert len(got) == 12 and asked == [12, 6, 1]
    assert ids((1, "BM25_ONLY")) == [10, 11] and ids((1, "VECTOR_ONLY")) == [12, 11] and ids((1, "HYBRID")) == [11, 10] and ids((1, "HYBRID_RERANK")) == [12, 10]
    assert (got[(2, "VECTOR_ONLY")].retries, got[(2, "BM25_ONLY")].retries, got[(2, "HYBRID")].degraded) == (1, 0, [])
    last = got[(3, "HYBRID_RERANK")]
    assert (last.retries, last.degraded, ids((3, "HYBRID_RERANK"))) == (2, ["rerank_unavailable"], [11, 10])


def test_no_recall_gives_no_hits(spark):
    cases = spark.createDataFrame([(1, "")], "case_id long, query string")
    none = lambda schema: spark.createDataFrame([], schema)
    got = runs.evaluation_run(cases, none("case_id long, route string, chunk_id long, score double"), none("case_id long, chunk_id long, rerank_score double"), none("case_id long, attempt int, service string")).collect()
    assert [(r.hits, r.degraded, r.retries) for r in got] == [([], [], 0)] * 4
    with pytest.raises(ValueError):
        runs.ask(cases, ("NEAREST",))


def test_judged_cases(spark):
    schema = "case_id long, mode string, degraded array<string>, hits array<struct<rank: int, chunk_id: long, score: double>>"
    out = spark.createDataFrame([(1, "HYBRID", [], [(1, 5, 1.0), (2, 6, 0.5), (3, 7, 0.1)]), (2, "HYBRID", [], [])], schema)
    chunks = spark.createDataFrame([(5, 50, "abcd zzz"), (6, 60, "xx efgh"), (7, 50, "!!!")], "chunk_id long, doc_id long, text string")
    evidence = spark.createDataFrame([(1, 60), (1, 70), (2, 60)], "case_id long, doc_id long")
    docs = {r.case_id: r for r in runs.judge_document_cases(out, evidence, chunks, 3).collect()}
    assert (docs[1].hit_rank, docs[1].evidence_hits, docs[1].evidence_total, docs[1].relevance) == (2, 1, 2, [False, True, False])
    assert (docs[2].hit, docs[2].hit_rank, docs[2].relevance) == (False, None, [False] * 3)
    spans = spark.createDataFrame([(1, 0, "abcdefgh"), (1, 1, "qqqq"), (2, 0, "abcd")], "case_id long, evidence_no int, span string")
    got = {r.case_id: r for r in runs.judge_span_cases(out, spans, chunks, 3, 0.6).collect()}
    assert (got[1].hit_rank, got[1].evidence_hits, got[1].evidence_total, got[1].relevance) == (2, 1, 2, [True, True, False])
    assert (got[2].hit, got[2].evidence_total) == (False, 1)
    m = ev.retrieval_metrics(runs.judge_span_cases(out, spans, chunks, 3, 0.6), 3, "mode").first()
    assert (m.cases, m.hit_rate, m.mrr) == (2, 0.5, 0.25)


@pytest.mark.parametrize("most", [5_000, 2])
def test_bm25_counts_in_rows(spark, monkeypatch, most):
    """Few and many terms give what a plain BM25 gives."""
    monkeypatch.setattr(recall, "MANY_TERMS", most)
    r = random.Random(4)
    texts = [" ".join(r.choice(["Aa", "bb", "cc", "dd", "ee9"]) for _ in range(r.randint(0, 12))) for _ in range(30)] + [None, "--"]
    asked = ["aa bb aa", "cc zz", "", "EE9"]
    got = {(x.query_id, x.chunk_id): x.score for x in recall.bm25(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), 100).collect()}
    words = [(t or "").lower().split() if t != "--" else [] for t in texts]
    mean = sum(map(len, words)) / len(words)
    expected = {}
    for q, text in enumerate(asked):
        for i, w in enumerate(words):
            terms = [t for t in dict.fromkeys(text.lower().split()) if t in w]
            if terms:
                idf = lambda t: math.log(1 + (len(words) - sum(t in x for x in words) + 0.5) / (sum(t in x for x in words) + 0.5))
                expected[q, i] = sum(idf(t) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms)  # noqa: B023
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-8 for k in got)


def test_vectors_in_blocks(spark, monkeypatch):
    """Blocks of few queries, ties, several vectors a query, and what has no score."""
    monkeypatch.setattr(recall, "QUERY_BLOCK", 3)
    r = random.Random(5)
    vectors = [(f"c{i:03}", [r.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(60)] + [("n", None), ("s", [1.0]), ("x", [1.0, None, 1.0]), ("y", [math.nan, 1.0, 1.0])]
    queries = [(i // 2, [r.choice([-1.0, 1.0]) for _ in range(3)]) for i in range(12)] + [(90, [0.0, 0.0, 0.0]), (91, None), (92, [2.0])]
    got = recall.multimodal_search(spark.createDataFrame(vectors, "chunk_id string, vector array<double>"), spark.createDataFrame(queries, "query_id long, vector array<double>"), 7)

    def near(a, b):
        if a is None or b is None or len(a) != len(b) or None in b or any(map(math.isnan, b)) or not any(a) or not any(b):
            return None
        return round(min(1, max(0, (sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b) + 1) / 2)), 6)

    expected = []
    for q in {q for q, _ in queries}:
        best = {c: max(s) for c, v in vectors if (s := [x for p, a in queries if p == q and (x := near(a, v)) is not None])}
        expected += [(q, n + 1, c, s) for n, (c, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:7])]
    assert sorted((x.query_id, x["rank"], x.chunk_id, x.score) for x in got.collect()) == sorted(expected)
