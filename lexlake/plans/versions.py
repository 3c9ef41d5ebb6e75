"""Queries of versions, synchronisation, evaluation and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.operators import evaluation as ev
from lexlake.operators import versions as v
from lexlake.plans.registry import query, view


@query("SELECT doc_id, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id DESC) AS r FROM {version}) WHERE r = 1")
def latest_version(spark, sf_dir):
    return v.latest(view(spark, sf_dir, "version"), "doc_id").select("doc_id", "id")


@query("""WITH b AS (SELECT doc_id AS chunk_id, 1 AS seq, 'old' AS src, 0 AS n FROM documents UNION ALL SELECT doc_id, doc_id % 3, 'new', 1 FROM documents WHERE doc_id % 2 = 0)
SELECT chunk_id, seq, src FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC, n DESC) AS r FROM b) WHERE r = 1""")
def index_upsert(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    old = d.select(F.col("doc_id").alias("chunk_id"), F.lit(1).cast("long").alias("seq"), F.lit("old").alias("src"))
    return v.upsert(old, d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id % 3").alias("seq"), F.lit("new").alias("src")))


_UPLOADS = "SELECT c_custkey AS doc_id, concat('h', CAST(c_custkey % 8 AS STRING)) AS content_hash, 'p0' AS parse_fp, 's0' AS chunk_fp, 'e1' AS embedding_version FROM {customer}"


@query(f"""WITH u AS ({_UPLOADS}), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY active DESC, id DESC) AS k, max(major * 100 + minor) OVER (PARTITION BY doc_id) AS top FROM {{version}}),
j AS (SELECT u.doc_id, top, h.active AND u.content_hash = h.content_hash AND u.parse_fp = h.parse_fp AND u.chunk_fp = h.chunk_fp AND u.embedding_version = h.embedding_version AS dup, u.content_hash = h.content_hash AS same FROM u LEFT JOIN h ON u.doc_id = h.doc_id AND h.k = 1)
SELECT doc_id, CASE WHEN top IS NULL THEN 'FIRST' WHEN dup THEN 'DUPLICATE' WHEN same THEN 'MINOR' ELSE 'MAJOR' END AS action,
CASE WHEN top IS NULL THEN '1.0' WHEN dup THEN NULL WHEN same THEN concat(top // 100, '.', top % 100 + 1) ELSE concat(top // 100 + 1, '.0') END AS version FROM j""")
def plan_version(spark, sf_dir):
    return v.plan_version(view(spark, sf_dir, "version"), spark.sql(_UPLOADS, customer=view(spark, sf_dir, "customer")))


#: Versions of which some are active and some have a blank parsed object.
_REUSABLE = "SELECT doc_id, id, content_hash, parse_fp, chunk_fp, CASE WHEN id % 7 = 0 THEN 'ACTIVE' ELSE status END AS status, CASE WHEN id % 11 = 0 THEN ' ' ELSE parsed_object END AS parsed_object FROM {version}"


@query(f"""WITH u AS ({_UPLOADS}), j AS (SELECT u.doc_id, h.id, CASE WHEN u.content_hash = h.content_hash AND u.parse_fp = h.parse_fp AND trim(h.parsed_object) <> '' THEN CASE WHEN u.chunk_fp = h.chunk_fp AND h.status = 'READY' THEN 2 ELSE 1 END ELSE 0 END AS l
FROM u LEFT JOIN ({_REUSABLE}) h USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, id) AS k FROM j) SELECT doc_id, ['NONE', 'PARSED', 'CHUNKS'][l + 1] AS reuse, CASE WHEN l > 0 THEN id END AS from_id FROM r WHERE k = 1""")
def reuse_level(spark, sf_dir):
    return v.reuse_level(spark.sql(_REUSABLE, version=view(spark, sf_dir, "version")), spark.sql(_UPLOADS, customer=view(spark, sf_dir, "customer")))


@query("""SELECT version_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM {version} WHERE status = 'READY' AND NOT active AND id % 7 <> 0) WHERE r > 3""")
def version_retention(spark, sf_dir):
    versions = view(spark, sf_dir, "version")
    return v.to_archive(versions, versions.filter("id % 7 = 0").select("version_id")).select("version_id")


@query("""WITH t AS (SELECT doc_id, arg_max(version_id, id) AS t FROM {version} WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT id, CASE WHEN version_id = t THEN 'ACTIVE' WHEN t IS NOT NULL AND (status = 'ACTIVE') THEN 'READY' ELSE status END AS status FROM {version} LEFT JOIN t USING (doc_id)""")
def activate_versions(spark, sf_dir):
    versions = view(spark, sf_dir, "version")
    return v.activate(versions, v.latest(versions.filter("doc_id % 2 = 0"), "doc_id")).select("id", "status")


@query("WITH f AS (SELECT kb_id, content_hash, min(doc_id) AS first_id FROM {document} GROUP BY 1, 2) SELECT d.kb_id, d.doc_id, first_id AS duplicate_of FROM {document} d JOIN f USING (kb_id, content_hash) WHERE d.doc_id <> first_id")
def duplicate_documents(spark, sf_dir):
    return v.duplicates_of(view(spark, sf_dir, "document"))


_LISTING = "SELECT concat('k', CAST(doc_id AS STRING)) AS object_key, CASE WHEN doc_id % 23 <> 0 THEN CAST(doc_id % 7 AS STRING) END AS etag, doc_id % 13 = 0 AS failed FROM {documents} WHERE doc_id % 5 <> 0"
_ITEMS = "SELECT concat('k', CAST(doc_id AS STRING)) AS object_key, CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'x' ELSE CAST(doc_id % 7 AS STRING) END AS etag, doc_id % 11 = 0 AS trashed, CASE WHEN doc_id % 2 = 0 THEN 'SKIPPED' END AS last_status FROM {documents} WHERE doc_id % 3 <> 0"
_OUTCOMES = f"""SELECT coalesce(l.object_key, i.object_key) AS object_key, CASE WHEN l.object_key IS NULL THEN 'SKIPPED' WHEN l.etag = i.etag THEN 'UNCHANGED' WHEN trashed THEN 'SKIPPED' WHEN failed THEN 'FAILED' ELSE 'SUCCESS' END AS status,
CASE WHEN l.object_key IS NULL THEN 'GONE' WHEN l.etag = i.etag THEN NULL WHEN trashed THEN 'TRASHED' WHEN failed THEN NULL WHEN i.object_key IS NULL THEN 'CREATED' ELSE 'UPDATED' END AS detail
FROM ({_LISTING}) l FULL JOIN ({_ITEMS}) i ON l.object_key = i.object_key WHERE l.object_key IS NOT NULL OR last_status IS NULL"""


@query(_OUTCOMES)
def sync_objects(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    return v.sync_objects(spark.sql(_LISTING, documents=d), spark.sql(_ITEMS, documents=d), truncated=False)


@query(f"SELECT CASE WHEN count(*) FILTER (WHERE status = 'FAILED') > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM ({_OUTCOMES})")
def sync_status(spark, sf_dir):
    return v.sync_status(sync_objects(spark, sf_dir), truncated=False)


_FETCHED = "SELECT page_id AS id, 't1' AS tenant_id, concat('h', CAST(page_id % 10 AS STRING)) AS host, md5(url) AS url_hash, md5(html) AS body_hash, page_id % 40 = 33 AS auth_failed FROM {pages}"


@query(f"""WITH f AS (SELECT *, coalesce(bool_or(auth_failed) OVER (PARTITION BY tenant_id, host ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS blocked FROM ({_FETCHED})),
k AS (SELECT md5(url) AS url_hash, max(CASE WHEN page_id % 3 = 0 THEN 'old' ELSE md5(html) END) AS known FROM pages WHERE page_id % 2 = 0 GROUP BY 1)
SELECT id, CASE WHEN blocked THEN 'BLOCKED' WHEN auth_failed THEN 'AUTH_FAILED' WHEN known IS NULL THEN 'CREATED' WHEN known = body_hash THEN 'UNCHANGED' ELSE 'UPDATED' END AS fate FROM f LEFT JOIN k USING (url_hash)""")
def sync_pages(spark, sf_dir):
    p = view(spark, sf_dir, "pages")
    known = p.filter("page_id % 2 = 0").groupBy(F.md5("url").alias("url_hash")).agg(F.max(F.expr("CASE WHEN page_id % 3 = 0 THEN 'old' ELSE md5(html) END")).alias("body_hash"))
    return v.sync_pages(spark.sql(_FETCHED, pages=p), known).select("id", "fate")


_ANNOTATIONS = "SELECT event_id AS id, event_id AS annotation_id, concat('t', CAST(user_id AS STRING)) AS text_hash, event_id % 2 = 0 AS enabled FROM {events}"
_CHUNKS = "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 <> 0 THEN doc_id - doc_id % 4 END AS parent_id, concat('t', CAST(doc_id % 300 AS STRING)) AS text_hash FROM {documents}"


@query(f"""WITH l AS (SELECT text_hash, arg_max(enabled, id) AS enabled, max(id) AS a FROM ({_ANNOTATIONS}) GROUP BY 1), d AS (SELECT c.chunk_id, l.enabled, l.a FROM ({_CHUNKS}) c JOIN l USING (text_hash)),
b AS (SELECT chunk_id, enabled, 10000000 + a AS k FROM d UNION ALL SELECT c.chunk_id, d.enabled, d.a FROM ({_CHUNKS}) c JOIN d ON c.parent_id = d.chunk_id) SELECT chunk_id, arg_max(enabled, k) AS enabled FROM b GROUP BY 1""")
def inherit_annotations(spark, sf_dir):
    return v.inherit_annotations(spark.sql(_ANNOTATIONS, events=view(spark, sf_dir, "events")), spark.sql(_CHUNKS, documents=view(spark, sf_dir, "documents")))


_MERGES = "SELECT l_orderkey AS merge_id, CAST(l_linenumber AS BIGINT) AS seq, 'd' AS doc_id, l_returnflag AS version_id, CAST(NULL AS STRING) AS parent_id FROM {lineitem} WHERE l_quantity > 20"


@query(f"""WITH g AS (SELECT *, coalesce(seq - lag(seq) OVER (PARTITION BY merge_id ORDER BY seq), 1) AS gap FROM ({_MERGES})) SELECT merge_id, count(DISTINCT version_id) = 1 AND min(gap) = 1 AND max(gap) = 1 AS mergeable, count(*) AS n FROM g GROUP BY 1""")
def contiguous_chunks(spark, sf_dir):
    return v.contiguous(spark.sql(_MERGES, lineitem=view(spark, sf_dir, "lineitem")))


@query("SELECT l_orderkey AS version_id, l_linenumber AS chunk_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) - 1 AS seq FROM lineitem")
def resequence_chunks(spark, sf_dir):
    rows = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("chunk_id"), F.col("l_partkey").alias("seq"))
    return v.resequence(rows)


_IMAGES = "SELECT l_orderkey AS doc_id, l_linenumber AS image_id, l_partkey AS start, l_partkey + 300 AS stop FROM {lineitem}"
_SPANS = "SELECT l_orderkey AS doc_id, l_suppkey AS chunk_id, l_partkey AS start, l_partkey + 200 AS stop FROM {lineitem}"


@query(f"SELECT DISTINCT a.doc_id, a.image_id, b.chunk_id FROM ({_IMAGES}) a JOIN ({_SPANS}) b ON a.doc_id = b.doc_id AND a.start < b.stop AND b.start < a.stop")
def link_images(spark, sf_dir):
    rows = view(spark, sf_dir, "lineitem")
    return v.link_images(spark.sql(_IMAGES, lineitem=rows), spark.sql(_SPANS, lineitem=rows), 512)


@query(f"""WITH s AS (SELECT doc_id, start, stop, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM ({_IMAGES}))
SELECT doc_id, CAST(sum(greatest(0, stop - greatest(start, coalesce(e, start)))) AS BIGINT) AS length FROM s GROUP BY 1""")
def interval_union(spark, sf_dir):
    return v.union_length(spark.sql(_IMAGES, lineitem=view(spark, sf_dir, "lineitem")), "doc_id")


@query("SELECT DISTINCT coalesce(parent_id, chunk_id) AS unit_id FROM {chunk} WHERE coalesce(parent_id, chunk_id) NOT IN (SELECT parent_id FROM {chunk} WHERE NOT enabled AND parent_id IS NOT NULL)")
def hide_parents(spark, sf_dir):
    chunks = view(spark, sf_dir, "chunk")
    return v.hide_parents(chunks.select(F.coalesce("parent_id", "chunk_id").alias("unit_id")).distinct(), chunks)


@query("""SELECT doc_id, md5(CASE WHEN length(text) < 20 THEN text ELSE concat(left(text, 5), '[hidden]', CASE WHEN doc_id % 2 = 0 THEN '' ELSE '[hidden]' END, substr(text, CASE WHEN doc_id % 2 = 0 THEN 8 ELSE 21 END)) END) AS h FROM documents""")
def redact_parents(spark, sf_dir):
    """Even ids: two spans that begin together. Odd ones: two that overlap. Texts under 20 characters: a span beyond the end."""
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"))
    spans = F.when(F.expr("doc_id % 2 = 0 AND char_length(text) >= 20"), F.array(span(5, 7), span(5, 15))).otherwise(F.array(span(12, 20), span(5, 15)))
    return view(spark, sf_dir, "documents").select("doc_id", F.md5(v.redact(F.col("text"), spans, "[hidden]")).alias("h"))


_FLAGS = "SELECT *, hit_rank FROM {case}"
_METRICS = """
SELECT g, count(*) AS cases, avg(evidence_hits / evidence_total) AS recall, avg(CASE WHEN hit AND hit_rank <= 3 THEN 1 ELSE 0 END / 3.0) AS precision, avg(hit::INT) AS hit_rate, avg(CASE WHEN hit THEN 1.0 / hit_rank ELSE 0 END) AS mrr,
avg(CASE WHEN hit AND hit_rank <= 3 THEN 1.0 / log2(hit_rank + 1) ELSE 0 END) AS ndcg, sum(evidence_hits)::DOUBLE AS eh, sum(evidence_total)::DOUBLE AS et, sum(hit::INT)::DOUBLE AS h FROM x GROUP BY g"""
_W = "(({0} / {1} + {2} 1.959963985 * sqrt({0} / {1} * (1 - {0} / {1}) / {1} + 1.959963985 * 1.959963985 / (4 * {1} * {1})) + 1.959963985 * 1.959963985 / (2 * {1})) / (1 + 1.959963985 * 1.959963985 / {1}))"


@query(
    "WITH x AS (SELECT *, unnest(['overall', lower(anchor_type), CASE WHEN turns > 1 THEN 'multi_turn' ELSE 'single_turn' END]) AS g FROM {case}), m AS (" + _METRICS + ") "
    "SELECT g AS \"group\", cases, round(recall, 6) AS recall, round(precision, 6) AS precision, round(hit_rate, 6) AS hit_rate, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, "
    + ", ".join(f"round({_W.format(a, b, s)}, 6) AS {n}" for a, b, s, n in (("eh", "et", "-", "recall_low"), ("eh", "et", "+", "recall_high"), ("h", "cases", "-", "hit_low"), ("h", "cases", "+", "hit_high")))
    + " FROM m"
)
def retrieval_metrics(spark, sf_dir):
    flags = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.coalesce(F.col("hit_rank") == i, F.lit(False)))
    cases = ev.metric_groups(view(spark, sf_dir, "case").withColumn("relevance", flags).withColumn("ideal_relevant", F.lit(1)))
    return ev.retrieval_metrics(cases, 3, "group")


@query("""SELECT anchor_type, count(*) FILTER (WHERE requested) AS requested, count(score) AS judged, round(avg(score), 6) AS avg_score, round(avg(correctness), 6) AS avg_correctness, round(avg(faithfulness), 6) AS avg_faithfulness,
round(avg(completeness), 6) AS avg_completeness, round(avg(refusal_correct::INT), 6) AS refusal_accuracy, count(*) FILTER (WHERE requested AND score IS NULL) AS failed, quantile_disc(latency_ms, 0.95) AS p95_latency_ms FROM {case} GROUP BY 1""")
def answer_metrics(spark, sf_dir):
    return ev.answer_metrics(view(spark, sf_dir, "case"), "anchor_type")


@query("SELECT case_id, CAST(greatest(1, least(5, round((correctness + faithfulness + completeness) / 3.0))) AS BIGINT) AS mark FROM {case}")
def judge_scores(spark, sf_dir):
    return view(spark, sf_dir, "case").select("case_id", ev.judge_score(F.col("correctness"), F.col("faithfulness"), F.col("completeness")).alias("mark"))


_EVIDENCE = "SELECT o_custkey AS case_id, o_orderkey % 50 AS doc_id FROM {orders} WHERE o_orderkey % 3 = 0"
_HITS = "SELECT o_custkey AS case_id, o_orderkey % 50 AS doc_id, o_orderkey % 10 + 1 AS rank FROM {orders} WHERE o_orderkey % 2 = 0"


@query(f"""WITH f AS (SELECT case_id, doc_id, min(rank) AS rank FROM ({_HITS}) GROUP BY 1, 2), e AS (SELECT DISTINCT case_id, doc_id FROM ({_EVIDENCE}))
SELECT case_id, count(rank) AS evidence_hits, count(*) AS evidence_total, min(rank) AS hit_rank, min(rank) IS NOT NULL AS hit FROM e LEFT JOIN f USING (case_id, doc_id) GROUP BY 1""")
def judge_documents(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    return ev.judge_documents(spark.sql(_EVIDENCE, orders=orders), spark.sql(_HITS, orders=orders))


@query()
def judge_spans(spark, sf_dir):
    """Each item against a document; documents are dealt to items over the whole table."""
    docs = view(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = F.expr("pmod(item_id * 7919, last + 1)").alias("doc_id")
    items = view(spark, sf_dir, "benchmark").join(F.broadcast(docs.agg(F.max("doc_id").alias("last")))).select(F.col("item_id").alias("case_id"), F.lit(0).alias("evidence_no"), dealt, F.col("text").alias("span"))
    ranked = items.select("case_id", "doc_id").join(docs, "doc_id").withColumn("rank", F.lit(1))
    return ev.judge_spans(items, ranked)


@query()
def overlap_ratio(spark, sf_dir):
    items = view(spark, sf_dir, "benchmark")
    other = items.select(F.expr("item_id + 1").alias("item_id"), F.col("text").alias("other"))
    return items.join(other, "item_id").select("item_id", ev.overlap_ratio(F.col("text"), F.col("other")).alias("ratio"))


def _runs(spark, sf_dir):
    cases = view(spark, sf_dir, "case")
    return cases.filter("seq % 5 <> 1"), cases.filter("seq % 5 <> 2").withColumn("hit", F.expr("seq % 3 <> 0")).withColumn("score", F.expr("score % 4 + 1"))


_GATES = """SELECT r_regionkey AS gate, r_regionkey <> 0 AS has_dataset, true AS run_ok, true AS comparable, CASE WHEN r_regionkey = 1 THEN 0.2 ELSE 0.1 END AS stale_rate, r_regionkey = 4 AS has_baseline,
    CASE WHEN r_regionkey = 2 THEN CAST(0.99 AS DOUBLE) END AS min_hit_rate, CASE WHEN r_regionkey = 2 THEN CAST(0.1 AS DOUBLE) END AS min_recall FROM {region}"""


@query(f"""WITH g AS ({_GATES}), c AS (SELECT * FROM {{case}} WHERE seq % 5 <> 1), b AS (SELECT *, seq % 3 <> 0 AS bhit FROM {{case}} WHERE seq % 5 <> 2),
m AS (SELECT count(*) AS cases, avg(c.hit::INT) AS hit_rate, avg(b.bhit::INT) AS base_hit_rate, avg(c.evidence_hits / c.evidence_total) AS recall, avg(b.evidence_hits / b.evidence_total) AS base_recall FROM c JOIN b USING (case_id) WHERE NOT c.degraded),
j AS (SELECT gate, CASE WHEN gate = 0 THEN 'NO_DATASET' WHEN cases < 50 THEN 'INSUFFICIENT_CASES' WHEN stale_rate > 0.15 THEN 'STALE_RATIO_EXCEEDED' WHEN gate = 2 AND (hit_rate < min_hit_rate OR recall < min_recall) THEN 'ABSOLUTE_THRESHOLD_NOT_MET' WHEN gate = 2 THEN 'ABSOLUTE_THRESHOLD_MET'
WHEN gate = 3 THEN 'BASELINE_RECORDED' WHEN hit_rate - base_hit_rate < -greatest(0.02, 1.0 / cases) - 1e-9 OR recall - base_recall < -greatest(0.02, 1.0 / cases) - 1e-9 THEN 'METRICS_REGRESSED' ELSE 'WITHIN_TOLERANCE' END AS reason FROM g, m)
SELECT gate, reason, CASE WHEN reason IN ('METRICS_REGRESSED', 'ABSOLUTE_THRESHOLD_NOT_MET') THEN 'BLOCKED' WHEN reason IN ('WITHIN_TOLERANCE', 'ABSOLUTE_THRESHOLD_MET', 'BASELINE_RECORDED') THEN 'PASSED' ELSE 'LOG_ONLY' END AS decision FROM j""")
def release_gate(spark, sf_dir):
    """By region: no dataset, stale cases, thresholds missed, a first release without any, a baseline."""
    candidate, baseline = _runs(spark, sf_dir)
    m = ev.gate_metrics(candidate.filter(~F.col("degraded")), baseline.withColumn("degraded", F.lit(False)))
    gates = spark.sql(_GATES, region=view(spark, sf_dir, "region"))
    return ev.release_gate(gates.join(F.broadcast(m))).select("gate", "reason", "decision")


#: Answers of two runs over cases: some not asked for, some of which the judgement failed; in the second group of gates none did.
_ANSWERS = """SELECT case_id, seq, requested, score IS NOT NULL AS judged, seq % 31 = 0 AS degraded, refusal_correct, CAST(score AS DOUBLE) AS score, CAST(correctness AS DOUBLE) AS correctness, CAST(faithfulness AS DOUBLE) AS faithfulness,
    CAST(completeness AS DOUBLE) AS completeness, CAST(seq % 7 AS DOUBLE) AS citation_correctness, CAST(seq % 3 AS DOUBLE) AS citation_completeness FROM {case}"""
#: Kinds of gates: nothing judged, failed judgements, too few cases, degraded ones; first releases without thresholds, above and below them; a baseline that is no better, one that is.
_AGATES = ("unavailable", "failed", "few", "degraded", "recorded", "met", "missed", "same", "worse", "refusals")
_AFILTER = {"failed": "TRUE", "few": "judged AND NOT degraded AND seq < 60", "degraded": "judged"}
_ABASE = {"same": "score", "worse": "score + CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END", "refusals": "score"}


def _answer_gate_sql() -> str:
    marks = ("score", "correctness", "faithfulness", "completeness", "citation_correctness", "citation_completeness")
    parts = []
    for g in _AGATES:
        kept, base = _AFILTER.get(g, "judged AND NOT degraded"), _ABASE.get(g)
        worse = f"(SELECT avg(CASE WHEN judged THEN {base} END) FROM k)" if base else "NULL"
        refusals = "(SELECT avg(CASE WHEN judged THEN 1 END) FROM k)" if g == "refusals" else "refusal_accuracy"
        parts.append(f"""SELECT '{g}' AS gate, * FROM (WITH k AS (SELECT * FROM a WHERE requested AND {kept}) SELECT {', '.join(f"coalesce(avg(CASE WHEN judged THEN {m} END), 0) AS {m}" for m in marks)}, coalesce(avg(CASE WHEN judged THEN refusal_correct::INT END), 0) AS refusal_accuracy,
        {worse} AS base_score, {refusals} AS base_refusal, count(*) FILTER (WHERE judged) AS cases, count(*) FILTER (WHERE NOT judged) AS failed, count(*) FILTER (WHERE degraded) AS degraded FROM k)""")
    return f"""WITH a AS ({_ANSWERS}), g AS ({' UNION ALL '.join(parts)}),
    r AS (SELECT gate, cases, round(score, 6) AS score, round(citation_correctness, 6) AS citation_correctness, CASE WHEN gate = 'unavailable' THEN 'ANSWER_EVAL_UNAVAILABLE' WHEN failed > 0 THEN 'ANSWER_JUDGE_FAILED' WHEN cases < 50 THEN 'ANSWER_INSUFFICIENT_CASES' WHEN degraded > 0 THEN 'DEGRADED_CASES'
    WHEN gate IN ('recorded', 'failed', 'few', 'degraded') THEN 'ANSWER_BASELINE_RECORDED' WHEN gate = 'met' THEN CASE WHEN score + 1e-9 >= 1 AND citation_correctness + 1e-9 >= 0.5 THEN 'ANSWER_ABSOLUTE_THRESHOLD_MET' END WHEN gate = 'missed' THEN CASE WHEN faithfulness + 1e-9 < 3.9 THEN 'ANSWER_ABSOLUTE_THRESHOLD_NOT_MET' END
    WHEN score - base_score < -0.2 - 1e-9 OR refusal_accuracy - base_refusal < -greatest(0.05, 1.0 / cases) - 1e-9 THEN 'ANSWER_METRICS_REGRESSED' ELSE 'ANSWER_WITHIN_TOLERANCE' END AS reason FROM g)
    SELECT *, CASE WHEN reason IN ('ANSWER_ABSOLUTE_THRESHOLD_NOT_MET', 'ANSWER_METRICS_REGRESSED') THEN 'BLOCKED' WHEN reason IN ('ANSWER_BASELINE_RECORDED', 'ANSWER_ABSOLUTE_THRESHOLD_MET', 'ANSWER_WITHIN_TOLERANCE') THEN 'PASSED' ELSE 'LOG_ONLY' END AS decision FROM r"""


@query(_answer_gate_sql())
def answer_gate(spark, sf_dir):
    """Every reason of the answer gate, over all cases."""
    answers = spark.sql(_ANSWERS, case=view(spark, sf_dir, "case"))
    out = None
    for g in _AGATES:
        run = answers.filter(_AFILTER.get(g, "judged AND NOT degraded"))
        base = run.withColumn("score", F.expr(_ABASE[g])).withColumn("refusal_correct", F.lit(True) if g == "refusals" else F.col("refusal_correct")) if g in _ABASE else None
        held = {"min_score": 1.0 if g == "met" else None, "min_faithfulness": 3.9 if g == "missed" else None, "min_citation_correctness": 0.5 if g == "met" else None, "min_refusal_accuracy": None}
        m = ev.answer_comparison(run, base).withColumns({k: F.lit(x).cast("double") for k, x in held.items()} | {"gate": F.lit(g), "available": F.lit(g != "unavailable")})
        out = m if out is None else out.unionByName(m)
    return ev.answer_gate(out).select("gate", "cases", "score", "citation_correctness", "reason", "decision")


_RUN_PAIRS = "SELECT o_custkey AS pair, o_orderkey AS run, concat('r', CAST(o_orderkey % 2 AS STRING)) AS dataset_revision, CASE WHEN o_orderkey % 5 > 0 THEN 'f' ELSE 'g' END AS corpus_fingerprint, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS judge_model, o_orderkey % 7 > 0 AS answer_enabled FROM {orders}"


@query(f"""WITH d AS (SELECT pair, count(DISTINCT dataset_revision) AS a, count(DISTINCT corpus_fingerprint) AS b, count(DISTINCT coalesce(judge_model, '')) AS c, count(DISTINCT answer_enabled) AS e FROM ({_RUN_PAIRS}) GROUP BY 1) SELECT pair, a = 1 AND b = 1 AND c = 1 AND e = 1 AS comparable FROM d""")
def run_comparability(spark, sf_dir):
    """Whether the orders of each customer, as runs, may be compared."""
    return ev.comparable(spark.sql(_RUN_PAIRS, orders=view(spark, sf_dir, "orders")), "pair")


@query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE turns > 1) AS m FROM {case}) SELECT c AS config_id, CASE WHEN c <> 'BM25' THEN n ELSE 0 END AS embeddings, CASE WHEN c = 'HYBRID_RERANK' THEN n ELSE 0 END AS reranks, m AS rewrites, CASE WHEN c = 'HYBRID_RERANK' THEN 2 * n ELSE 0 END AS answer_calls FROM s, (VALUES ('BM25'), ('HYBRID_RERANK')) t(c)""")
def call_estimate(spark, sf_dir):
    configs = spark.createDataFrame([("BM25", False, False, True, False), ("HYBRID_RERANK", True, True, True, True)], "config_id string, vector boolean, rerank boolean, rewrite boolean, answers boolean")
    return ev.call_estimate(view(spark, sf_dir, "case"), configs)


@query("SELECT sha256(concat_ws('|', (SELECT string_agg(DISTINCT version_id, ',' ORDER BY version_id) FROM {version}), 'm:64', 'a', 'b')) AS fingerprint")
def corpus_fingerprint(spark, sf_dir):
    return ev.corpus_fingerprint(view(spark, sf_dir, "version"), "m:64", ["b", "a"])


_FEEDBACK = "SELECT event_id AS feedback_id, CASE WHEN event_id % 5 > 0 THEN 'NEW' ELSE 'DISMISSED' END AS status, CASE WHEN event_id % 3 = 0 THEN 'BAD' ELSE 'GOOD' END AS verdict, event_type AS query, CASE WHEN event_id % 7 > 0 THEN concat('c', CAST(user_id AS STRING)) ELSE 'gone' END AS chunk_id FROM {events}"
_RECALLED = "SELECT concat('c', CAST(doc_id AS STRING)) AS chunk_id, doc_id, md5(text) AS content, CASE WHEN doc_id % 4 = 0 THEN 'IMAGE' ELSE 'TEXT' END AS chunk_type FROM {documents}"
_CONVERTED = f"f AS (SELECT f.*, c.doc_id, c.content, c.chunk_type, CASE WHEN status <> 'NEW' THEN 'NOT_NEW' WHEN verdict = 'BAD' THEN 'BAD' WHEN c.chunk_id IS NULL THEN 'NO_CHUNK' END AS refused, 'case_' || left(sha256('d1|' || feedback_id), 24) AS id FROM ({_FEEDBACK}) f LEFT JOIN ({_RECALLED}) c USING (chunk_id))"


def _feedback_cases(spark, sf_dir):
    return ev.feedback_cases(spark.sql(_FEEDBACK, events=view(spark, sf_dir, "events")), spark.sql(_RECALLED, documents=view(spark, sf_dir, "documents")), "d1")


@query(f"WITH {_CONVERTED} SELECT id AS case_id, 'd1' AS dataset_id, query, CASE WHEN chunk_type = 'IMAGE' THEN 'DOCUMENT' ELSE 'SPAN' END AS anchor_type, doc_id, CASE WHEN chunk_type <> 'IMAGE' THEN content END AS span, 'FEEDBACK' AS source FROM f WHERE refused IS NULL")
def feedback_cases(spark, sf_dir):
    return _feedback_cases(spark, sf_dir)[0]


@query(f"WITH {_CONVERTED} SELECT feedback_id, CASE WHEN refused IS NULL THEN 'CONVERTED' ELSE status END AS status, CASE WHEN refused IS NULL THEN id END AS case_id, refused FROM f")
def feedback_status(spark, sf_dir):
    return _feedback_cases(spark, sf_dir)[1]
