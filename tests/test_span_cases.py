"""Spans of many cases are judged many to a batch."""

import io
from contextlib import redirect_stdout

from lexlake.operators import runs


def test_spans_need_no_group_in_python(spark):
    schema = "case_id long, mode string, degraded array<string>, hits array<struct<rank: int, chunk_id: long, score: double>>"
    out = spark.createDataFrame([(1, "HYBRID", [], [(1, 5, 1.0), (2, 6, 0.5), (3, 7, 0.1)]), (1, "BM25_ONLY", [], [(1, 7, 1.0), (2, 6, 0.5)]), (2, "HYBRID", [], [])], schema)
    chunks = spark.createDataFrame([(5, "abcd zzz"), (6, "xx efgh"), (7, "!!!")], "chunk_id long, text string")
    spans = spark.createDataFrame([(1, 0, "abcdefgh"), (1, 1, "qqqq"), (1, 2, ""), (2, 0, "abcd")], "case_id long, evidence_no int, span string")
    judged = runs.judge_span_cases(out, spans, chunks, 3, 0.6)
    got = {(r.case_id, r["mode"]): (r.hit, r.hit_rank, r.evidence_hits, r.evidence_total) for r in judged.collect()}
    assert got == {(1, "HYBRID"): (True, 2, 1, 3), (1, "BM25_ONLY"): (False, None, 0, 3), (2, "HYBRID"): (False, None, 0, 1)}
    with redirect_stdout(io.StringIO()) as plan:
        judged.explain()
    assert "FlatMapGroupsInPandas" not in plan.getvalue()
