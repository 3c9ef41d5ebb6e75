"""Queries of evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.operators import evaluation as ev
from lexlake.operators import runs
from lexlake.plans.registry import query, view

#: Every twentieth document asks by its first words, and by its own vector or the next one's. VECTOR and RERANK are out for some cases, at some attempts.
_CASE = "SELECT doc_id AS case_id, substr(coalesce(text, ''), 1, 60) AS query FROM {documents} WHERE doc_id % 20 = 0"
_OUT = "SELECT c.case_id, t.attempt, t.service FROM {run_case} c JOIN (VALUES (60, 0, 'VECTOR'), (100, 0, 'RERANK'), (100, 1, 'RERANK'), (100, 2, 'RERANK'), (140, 0, 'VECTOR'), (140, 1, 'VECTOR')) AS t(every, attempt, service) ON c.case_id % t.every = 0"
_RERANK = "SELECT DISTINCT case_id, chunk_id, CAST((case_id + chunk_id * 7) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS rerank_score FROM {routes} WHERE chunk_id % 13 <> 0"

_RUN = r"""
c AS MATERIALIZED (SELECT doc_id AS case_id, substr(coalesce(text, ''), 1, 60) AS query FROM documents WHERE doc_id % 20 = 0),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}0-9]+')) AS term FROM documents),
dl AS MATERIALIZED (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY 1),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
terms AS MATERIALIZED (SELECT DISTINCT case_id, unnest(regexp_extract_all(lower(query), '[\p{L}0-9]+')) AS term FROM c),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT case_id, doc_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM terms JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2),
q AS (SELECT case_id, embedding AS qv FROM c JOIN embeddings ON vec_id = CASE WHEN case_id % 40 = 0 THEN case_id ELSE case_id + 1 END),
cs AS (SELECT case_id, vec_id AS chunk_id, round(greatest(0, least(1, (list_sum(list_transform(list_zip(embedding, qv), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(qv, lambda x: x::DOUBLE * x::DOUBLE)))) + 1) / 2)), 6) AS score FROM embeddings, q),
routes AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY case_id, service ORDER BY score DESC, chunk_id) AS rank FROM (SELECT *, 'BM25' AS service FROM bm UNION ALL SELECT *, 'VECTOR' FROM cs) QUALIFY rank <= 50),
m(mode, service) AS (VALUES ('BM25_ONLY', 'BM25'), ('VECTOR_ONLY', 'VECTOR'), ('HYBRID', 'BM25'), ('HYBRID', 'VECTOR'), ('HYBRID_RERANK', 'BM25'), ('HYBRID_RERANK', 'VECTOR'), ('HYBRID_RERANK', 'RERANK')),
o AS (SELECT case_id, attempt, service FROM c JOIN (VALUES (60, 0, 'VECTOR'), (100, 0, 'RERANK'), (100, 1, 'RERANK'), (100, 2, 'RERANK'), (140, 0, 'VECTOR'), (140, 1, 'VECTOR')) t(every, attempt, service) ON case_id % every = 0),
tries AS (SELECT c.case_id, m.mode, a.attempt, count(o.service) AS bad FROM c CROSS JOIN m CROSS JOIN range(3) a(attempt) LEFT JOIN o ON o.case_id = c.case_id AND o.attempt = a.attempt AND o.service = m.service GROUP BY ALL),
last AS MATERIALIZED (SELECT case_id, mode, coalesce(min(attempt) FILTER (WHERE bad = 0), 2) AS attempt FROM tries GROUP BY ALL),
bad AS (SELECT l.case_id, l.mode, string_agg(DISTINCT CASE o.service WHEN 'VECTOR' THEN 'vector_route_unavailable' ELSE 'rerank_unavailable' END, ',' ORDER BY CASE o.service WHEN 'VECTOR' THEN 'vector_route_unavailable' ELSE 'rerank_unavailable' END) AS degraded
  FROM last l JOIN m USING (mode) JOIN o ON o.case_id = l.case_id AND o.attempt = l.attempt AND o.service = m.service GROUP BY ALL),
up AS (SELECT l.case_id, l.mode, m.service FROM last l JOIN m USING (mode) WHERE NOT EXISTS (FROM o WHERE o.case_id = l.case_id AND o.attempt = l.attempt AND o.service = m.service)),
f AS (SELECT case_id, mode, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS fused, max(score) FILTER (WHERE service = 'BM25') AS b FROM up JOIN routes USING (case_id, service) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY case_id, mode ORDER BY fused DESC, chunk_id) AS position FROM f QUALIFY position <= 50),
r AS (SELECT p.*, CASE WHEN chunk_id % 13 <> 0 AND u.case_id IS NOT NULL THEN ((p.case_id + chunk_id * 7) % 101)::DOUBLE / 100::DOUBLE END AS rr, min(coalesce(b, 0)) OVER w AS lo, max(coalesce(b, 0)) OVER w AS hi
  FROM p LEFT JOIN up u ON u.case_id = p.case_id AND u.mode = p.mode AND u.service = 'RERANK' WINDOW w AS (PARTITION BY p.case_id, p.mode)),
h AS (SELECT *, 0.7::DOUBLE * rr + (1 - 0.7::DOUBLE) * CASE WHEN hi - lo <= 1e-9 THEN 0 ELSE (coalesce(b, 0) - lo) / (hi - lo) END AS hybrid FROM r),
hits AS MATERIALIZED (SELECT case_id, mode, chunk_id, coalesce(hybrid, fused) AS score, row_number() OVER (PARTITION BY case_id, mode ORDER BY hybrid IS NULL, coalesce(hybrid, fused) DESC, chunk_id) AS rank FROM h QUALIFY rank <= 5)"""


def _outcomes(spark, sf_dir):
    docs, vectors = view(spark, sf_dir, "documents"), view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    cases = spark.sql(_CASE, documents=docs)
    queries = cases.select("case_id", F.expr("CASE WHEN case_id % 40 = 0 THEN case_id ELSE case_id + 1 END").alias("chunk_id")).join(vectors, "chunk_id").select("case_id", "vector")
    routes = runs.recall_cases(cases, docs.select(F.col("doc_id").alias("chunk_id"), "text"), vectors, queries)
    return runs.evaluation_run(cases, routes, spark.sql(_RERANK, routes=routes), spark.sql(_OUT, run_case=cases))


@query(f"""WITH {_RUN}
SELECT case_id, mode, coalesce(degraded, '') AS degraded, attempt::BIGINT AS retries, coalesce(string_agg(chunk_id, ',' ORDER BY rank), '') AS hits, round(max(score), 6) AS best FROM last LEFT JOIN bad USING (case_id, mode) LEFT JOIN hits USING (case_id, mode) GROUP BY ALL""")
def evaluation_run(spark, sf_dir):
    """Every case in four modes, from one recall, with up to two rounds of retries."""
    out = _outcomes(spark, sf_dir)
    hits = F.array_join(F.transform("hits", lambda h: h["chunk_id"].cast("string")), ",")
    return out.select("case_id", "mode", F.array_join("degraded", ",").alias("degraded"), "retries", hits.alias("hits"), F.array_max(F.transform("hits", lambda h: h["score"])).alias("best"))


_W = "(({0} / {1} + {2} 1.959963985 * sqrt({0} / {1} * (1 - {0} / {1}) / {1} + 1.959963985 * 1.959963985 / (4 * {1} * {1})) + 1.959963985 * 1.959963985 / (2 * {1})) / (1 + 1.959963985 * 1.959963985 / {1}))"


@query(f"""WITH {_RUN},
e AS (SELECT case_id, doc_id FROM c JOIN documents ON doc_id IN (case_id, case_id + 1)),
w AS (SELECT case_id, mode, doc_id, min(rank) AS rank FROM last JOIN e USING (case_id) LEFT JOIN (SELECT case_id, mode, chunk_id AS doc_id, rank FROM hits) USING (case_id, mode, doc_id) GROUP BY ALL),
j AS (SELECT case_id, mode, min(rank) AS first, count(rank)::DOUBLE AS eh, count(*)::DOUBLE AS et, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM w GROUP BY ALL),
x AS (SELECT mode, count(*)::DOUBLE AS n, avg(eh / et) AS recall, avg(eh / 5) AS precision, avg((first IS NOT NULL)::INT) AS hit_rate, avg(coalesce(1.0 / first, 0)) AS mrr, avg(dcg / CASE WHEN et = 1 THEN 1 ELSE 1 + 1 / log2(3) END) AS ndcg, sum(eh) AS seh, sum(et) AS pairs, count(first)::DOUBLE AS found FROM j GROUP BY 1)
SELECT mode, n::BIGINT AS cases, round(recall, 6) AS recall, round(precision, 6) AS precision, round(hit_rate, 6) AS hit_rate, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, """
    + ", ".join(f"round(greatest(0, least(1, {_W.format(a, b, s)})), 6) AS {n}" for a, b, s, n in (("seh", "pairs", "-", "recall_low"), ("seh", "pairs", "+", "recall_high"), ("found", "n", "-", "hit_low"), ("found", "n", "+", "hit_high")))
    + " FROM x")
def evaluation_run_documents(spark, sf_dir):
    """Metrics by mode, of cases that look for their own document and the next."""
    docs = view(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("chunk_id"))
    cases = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("case_id"))
    evidence = cases.select("case_id", F.explode(F.array("case_id", F.col("case_id") + 1)).alias("doc_id")).join(docs.select("doc_id"), "doc_id", "left_semi")
    return ev.retrieval_metrics(runs.judge_document_cases(_outcomes(spark, sf_dir), evidence, docs), 5, "mode")


@query()
def evaluation_run_spans(spark, sf_dir):
    """Metrics by mode, of cases that look for the words that their document begins with."""
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    evidence = docs.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("case_id"), F.lit(0).alias("evidence_no"), F.expr("substr(coalesce(text, ''), 1, 60)").alias("span"))
    return ev.retrieval_metrics(runs.judge_span_cases(_outcomes(spark, sf_dir), evidence, docs), 5, "mode")
