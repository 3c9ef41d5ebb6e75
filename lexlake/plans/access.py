"""Queries of access, consoles, results of a search, and evaluation cases against versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.operators import access as a
from lexlake.operators import evaluation as ev
from lexlake.plans.registry import query, view

_GRANTS = "SELECT doc_id, concat('r', CAST(doc_id % 5 AS STRING)) AS role_id FROM {documents} WHERE doc_id % 4 = 0"


@query(f"SELECT doc_id FROM {{document}} WHERE visibility <> 'RESTRICTED' OR doc_id IN (SELECT doc_id FROM ({_GRANTS}) WHERE role_id IN ('r1', 'r3'))")
def content_guard(spark, sf_dir):
    return a.readable(view(spark, sf_dir, "document"), spark.sql(_GRANTS, documents=view(spark, sf_dir, "documents")), ["r1", "r3"]).select("doc_id")


@query("SELECT id FROM {usage} WHERE tenant_id = 't3'")
def tenant_fence(spark, sf_dir):
    return a.fenced(view(spark, sf_dir, "usage"), "t3").select("id")


_USER_ROLES = "SELECT c_custkey AS user_id, concat('r', CAST(c_custkey % 4 AS STRING)) AS role_id FROM {customer} UNION ALL SELECT c_custkey, concat('r', CAST(c_custkey % 6 AS STRING)) FROM {customer}"
_PERMISSIONS = "SELECT concat('r', CAST(n_nationkey % 5 AS STRING)) AS role_id, n_name AS permission FROM {nation}"
_BASES = "SELECT concat('r', CAST(r_regionkey AS STRING)) AS role_id, concat('kb', CAST(r_regionkey % 3 AS STRING)) AS kb_id FROM {region} WHERE r_regionkey > 1"


@query(f"""WITH u AS (SELECT DISTINCT * FROM ({_USER_ROLES})), p AS (SELECT user_id, string_agg(DISTINCT permission, ',' ORDER BY permission) AS permissions FROM u JOIN ({_PERMISSIONS}) USING (role_id) GROUP BY 1),
b AS (SELECT user_id, string_agg(DISTINCT kb_id, ',' ORDER BY kb_id) AS kb_ids FROM u JOIN ({_BASES}) USING (role_id) GROUP BY 1) SELECT DISTINCT user_id, coalesce(permissions, '') AS permissions, coalesce(kb_ids, '') AS kb_ids FROM u LEFT JOIN p USING (user_id) LEFT JOIN b USING (user_id)""")
def principal_scope(spark, sf_dir):
    of = lambda sql, name: spark.sql(sql, **{name: view(spark, sf_dir, name)})
    out = a.principal_scope(of(_USER_ROLES, "customer"), of(_PERMISSIONS, "nation"), of(_BASES, "region"))
    return out.select("user_id", F.array_join("permissions", ",").alias("permissions"), F.array_join("kb_ids", ",").alias("kb_ids"))


@query("SELECT c_custkey FROM customer WHERE position('#00000001' IN lower(c_name)) > 0")
def name_search(spark, sf_dir):
    return view(spark, sf_dir, "customer").filter(a.holds(F.col("c_name"), "#00000001")).select("c_custkey")


@query("""WITH f AS (SELECT id, query_hash AS request_id, concat('c', CAST(id % 1000 AS STRING)) AS chunk_id FROM {insight} WHERE zero_hit), i AS (SELECT query_hash AS request_id, arg_max(kb_id, id) AS kb_id FROM {insight} WHERE NOT zero_hit GROUP BY 1)
SELECT f.id, i.kb_id, coalesce(i.kb_id = c.kb_id, false) AS owned FROM f LEFT JOIN i USING (request_id) LEFT JOIN {chunk} c ON c.chunk_id = f.chunk_id""")
def feedback_bases(spark, sf_dir):
    insight = view(spark, sf_dir, "insight").withColumn("request_id", F.col("query_hash"))
    feedback = insight.filter("zero_hit").select("id", "request_id", F.concat(F.lit("c"), F.expr("id % 1000")).alias("chunk_id"))
    return a.feedback_bases(feedback, insight.filter("NOT zero_hit"), view(spark, sf_dir, "chunk"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE")
def stale_reservations(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_type") == "click", "RESERVED").otherwise("DONE").alias("status"), F.col("ts").alias("created_at"))
    return a.stale_reservations(rows.join(F.broadcast(e.agg(F.max("ts").alias("now")))), F.col("now"), F.lit(2)).select("event_id")


_STALE = "SELECT kb_id, doc_id % 3 <> 1 AS config_stale, current_version, CASE doc_id % 5 WHEN 0 THEN 'PARSING' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'INDEXING' ELSE 'READY' END AS process_status FROM {document}"


@query(f"SELECT kb_id, count(*) AS stale, count(*) FILTER (WHERE process_status IN ('PARSING', 'INDEXING')) AS in_progress, count(*) FILTER (WHERE process_status = 'FAILED') AS failed FROM ({_STALE}) WHERE config_stale AND current_version IS NOT NULL GROUP BY 1")
def rebuild_status(spark, sf_dir):
    return a.rebuild_status(spark.sql(_STALE, document=view(spark, sf_dir, "document")), ("PARSING", "INDEXING"))


_WORDS = "SELECT CASE WHEN p_partkey % 8 = 0 THEN concat('off ', p_type) ELSE p_type END AS dict_type, p_name AS word, p_partkey % 4 <> 0 AS enabled, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS updated_ms FROM {part}"


@query(f"WITH w AS (SELECT dict_type, coalesce(string_agg(word || chr(10), '' ORDER BY word) FILTER (WHERE enabled), '') AS body, coalesce(max(updated_ms) FILTER (WHERE enabled), 0) AS last_modified, count(*) FILTER (WHERE enabled) AS entries FROM ({_WORDS}) GROUP BY 1) SELECT dict_type, md5(body) AS body, sha256(body) AS etag, last_modified, entries FROM w")
def dictionaries(spark, sf_dir):
    return a.render_dictionary(spark.sql(_WORDS, part=view(spark, sf_dir, "part"))).withColumn("body", F.md5("body"))


@query("SELECT event_type AS source, count(*) AS calls, coalesce(sum(CAST(floor(value) AS BIGINT)), 0)::BIGINT AS total_ms, max(CAST(floor(value) AS BIGINT)) AS max_ms, count(*) FILTER (WHERE event_id % 6 = 0) AS zero_hits, count(*) FILTER (WHERE event_id % 9 = 0) AS degraded FROM events GROUP BY 1")
def online_metrics(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    return a.online_metrics(e.select(F.col("event_type").alias("source"), F.floor("value").cast("long").alias("latency_ms"), F.expr("event_id % 6 = 0").alias("zero_hit"), F.expr("event_id % 9 = 0").alias("degraded")))


@query("SELECT DISTINCT v.doc_id, v.version_id, concat('app', CAST(v.doc_id % 7 AS STRING)) AS app_id FROM {version} v WHERE v.id % 3 = 0")
def pinned_versions(spark, sf_dir):
    v = view(spark, sf_dir, "version")
    apps = v.filter("id % 3 = 0").groupBy(F.concat(F.lit("app"), F.expr("doc_id % 7")).alias("app_id"), "doc_id").agg(F.to_json(F.collect_list("version_id")).alias("visible_versions"))
    return a.pinned_versions(apps, v.select("doc_id", "version_id"))


_APPS = "SELECT c_custkey AS app_id, c_nationkey AS kb_id, CASE WHEN c_custkey % 4 > 0 THEN concat('t', CAST(c_custkey % 10 AS STRING)) END AS fulltext_index, CASE WHEN c_custkey % 3 > 0 THEN concat('v', CAST(c_custkey % 10 AS STRING)) END AS vector_index, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 > 0 THEN concat('f', CAST(c_custkey AS STRING), ',g') END AS frozen FROM {customer}"
_LIVE = "SELECT n_nationkey AS kb_id, concat('live', CAST(n_nationkey AS STRING)) AS live_index, concat(n_name, ',g,h') AS versions FROM {nation}"
_INDEXES = "SELECT concat('t', CAST(n_nationkey AS STRING)) AS index_name FROM {nation} WHERE n_nationkey < 8 UNION ALL SELECT concat('v', CAST(n_nationkey AS STRING)) FROM {nation} WHERE n_nationkey > 3"


@query(f"""WITH i AS (SELECT DISTINCT index_name AS n FROM ({_INDEXES})), j AS (SELECT a.*, live_index, versions, coalesce(fulltext_index IS NOT NULL AND frozen <> '', false) AS meant, meant AND coalesce(fulltext_index IN (SELECT n FROM i), false) AND (vector_index IS NULL OR vector_index IN (SELECT n FROM i)) AS whole FROM ({_APPS}) a LEFT JOIN ({_LIVE}) l USING (kb_id))
SELECT app_id, CASE WHEN whole THEN fulltext_index ELSE live_index END AS index_name, replace(CASE WHEN whole THEN frozen ELSE versions END, CASE WHEN kb_id % 2 = 0 THEN ',g' ELSE ',-' END, '') AS versions, meant AND NOT whole AS degraded FROM j""")
def resolved_indexes(spark, sf_dir):
    n = view(spark, sf_dir, "nation")
    split = lambda df, c: df.withColumn(c, F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ",")))
    hidden = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("kb_id"), F.array(F.lit("g"), F.lit("x")).alias("hidden"))
    out = a.resolved_indexes(split(spark.sql(_APPS, customer=view(spark, sf_dir, "customer")), "frozen"), split(spark.sql(_LIVE, nation=n), "versions"), spark.sql(_INDEXES, nation=n), hidden)
    return out.withColumn("versions", F.array_join("versions", ","))


_SNAPSHOTS = "SELECT o_orderkey AS id, o_custkey AS app_id, CASE WHEN o_orderstatus = 'O' THEN 'RELEASED' ELSE 'SUPERSEDED' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS released_at FROM {orders}"


@query(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY app_id ORDER BY released_at DESC NULLS LAST, id DESC) AS r FROM ({_SNAPSHOTS}) WHERE status = 'SUPERSEDED') WHERE r > 3")
def snapshot_retention(spark, sf_dir):
    return a.snapshots_to_archive(spark.sql(_SNAPSHOTS, orders=view(spark, sf_dir, "orders"))).select("id")


_STATES = ["DRAFT", "TESTING", "GATING", "GATE_PASSED", "GATE_LOG_ONLY", "GATE_BLOCKED", "RELEASED", "SUPERSEDED"]


@query(f"SELECT event_id, ({_STATES}[CAST(event_id % 8 AS INT) + 1] || '>' || {_STATES}[CAST((event_id // 8) % 8 AS INT) + 1]) IN ('DRAFT>TESTING', 'TESTING>GATING', 'TESTING>GATE_PASSED', 'TESTING>GATE_LOG_ONLY', 'TESTING>GATE_BLOCKED', 'GATING>GATE_PASSED', 'GATING>GATE_LOG_ONLY', 'GATING>GATE_BLOCKED', 'GATE_PASSED>RELEASED', 'GATE_LOG_ONLY>RELEASED', 'GATE_BLOCKED>RELEASED', 'RELEASED>SUPERSEDED', 'SUPERSEDED>RELEASED') AS may FROM events")
def app_states(spark, sf_dir):
    states = F.array(*map(F.lit, _STATES))
    return view(spark, sf_dir, "events").select("event_id", a.may_become(F.get(states, F.expr("event_id % 8")), F.get(states, F.expr("(event_id div 8) % 8"))).alias("may"))


@query("SELECT doc_id, 'doc_' || left(sha256(concat_ws('|', source, CAST(doc_id AS STRING))), 24) AS id FROM documents")
def business_ids(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", a.business_id("doc", F.col("source"), F.col("doc_id")).alias("id"))


_PARTS = "SELECT concat(CASE WHEN doc_id % 6 = 0 THEN 'p' ELSE 'c' END, CAST(doc_id AS STRING)) AS chunk_id, md5(text) AS content FROM {documents} WHERE doc_id % 9 <> 0"
_HITS = "SELECT doc_id % 20 AS query_id, concat('p', CAST(doc_id - doc_id % 6 AS STRING)) AS unit_id, concat('c', CAST(doc_id AS STRING)) AS best, doc_id FROM {documents} WHERE doc_id % 6 <> 0"


@query(f"SELECT h.doc_id, coalesce(p.content, c.content) AS content, CASE WHEN p.content IS NOT NULL THEN 'PARENT' WHEN c.content IS NOT NULL THEN 'CHILD' END AS hydrated FROM ({_HITS}) h LEFT JOIN ({_PARTS}) p ON p.chunk_id = h.unit_id LEFT JOIN ({_PARTS}) c ON c.chunk_id = h.best")
def hydrate_units(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    return a.hydrate(spark.sql(_HITS, documents=d), spark.sql(_PARTS, documents=d)).select("doc_id", "content", "hydrated")


_SEQ = "SELECT concat('o', CAST(l_orderkey AS STRING)) AS parent_id, CAST(l_linenumber AS BIGINT) AS seq, l_partkey AS start, l_partkey + 10 AS stop, l_quantity > 25 AS enabled FROM {lineitem}"


@query(f"WITH k AS (SELECT parent_id AS chunk_id, string_agg(concat(seq, ':', start, '-', stop), ',' ORDER BY seq, start, stop) AS children FROM ({_SEQ}) WHERE NOT enabled GROUP BY 1) SELECT concat('o', o_orderkey) AS chunk_id, coalesce(children, '') AS children FROM orders LEFT JOIN k ON k.chunk_id = concat('o', o_orderkey)")
def disabled_children(spark, sf_dir):
    parents = view(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("chunk_id"))
    out = a.disabled_children(parents, spark.sql(_SEQ, lineitem=view(spark, sf_dir, "lineitem")))
    return out.select("chunk_id", F.array_join(F.transform("children", lambda x: F.concat(x["seq"].cast("string"), F.lit(":"), x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"))), ",").alias("children"))


@query("""WITH k AS (SELECT l_orderkey AS u, string_agg(concat('c', l_linenumber), ',' ORDER BY l_quantity DESC, concat('c', l_linenumber)) AS children FROM lineitem GROUP BY 1)
SELECT o_custkey AS query_id, o_orderkey AS position, concat('o', o_orderkey) AS node_id, o_comment AS text, CAST(o_custkey AS STRING) AS doc, CAST(o_orderkey AS STRING) AS rank, children FROM (SELECT *, o_orderpriority AS o_comment FROM orders) LEFT JOIN k ON u = o_orderkey""")
def node_views(spark, sf_dir):
    hits = view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("unit_id"), F.col("o_orderkey").alias("position"), F.lit(0.5).alias("score"), F.col("o_orderpriority").alias("content"), F.col("o_custkey").alias("doc_id"))
    lines = view(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("unit_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("chunk_id"), F.col("l_quantity").alias("score"))
    seen = a.node_view(hits, lines.join(hits.select("query_id", "unit_id"), "unit_id"))
    return seen.select("query_id", "position", "node_id", "text", F.col("metadata")["doc_id"].alias("doc"), F.col("metadata")["rank"].alias("rank"), F.array_join(F.transform("children", lambda x: x["chunk_id"]), ",").alias("children"))


@query("SELECT doc_id, lang AS ext_lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'x' END AS ext_tag, false AS has_source, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS msg_time FROM documents")
def ext_metadata(spark, sf_dir):
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("tag"), F.when(F.expr("doc_id % 3 = 0"), " ").otherwise("x"))
    flat = view(spark, sf_dir, "documents").select("doc_id", a.flattened_metadata(meta, ["source"]).alias("m"), a.epoch_ms(F.when(F.expr("doc_id % 2 = 0"), F.concat(F.lit(" "), F.col("doc_id").cast("string"))).otherwise("soon")).alias("msg_time"))
    return flat.select("doc_id", F.col("m")["ext_lang"].alias("ext_lang"), F.col("m")["ext_tag"].alias("ext_tag"), F.map_contains_key("m", "ext_source").alias("has_source"), "msg_time")


@query("WITH f AS (SELECT o_custkey AS query_id, o_orderkey % 7 AS d, min(o_orderkey) AS p FROM orders GROUP BY 1, 2) SELECT query_id, string_agg(d, ',' ORDER BY p) AS doc_ids FROM f GROUP BY 1")
def ordered_documents(spark, sf_dir):
    hits = view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("position"), F.expr("o_orderkey % 7").alias("doc_id"))
    return a.ordered_documents(hits).select("query_id", F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


def _cases(spark, sf_dir):
    """Evidence is the head of a document (of every third, of another one); chunks are whole documents."""
    d = view(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.lit("v1").alias("version_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    span = F.when(F.expr("doc_id % 3 = 0"), F.repeat(F.lit("~"), 30)).otherwise(F.substring("content", 1, 40))
    evidence = d.select(F.col("doc_id").alias("case_id"), F.lit(1).alias("evidence_no"), "doc_id", "version_id", span.alias("span"))
    cases = d.select(F.col("doc_id").alias("case_id"), F.when(F.expr("doc_id % 4 = 0"), "DOCUMENT").otherwise("SPAN").alias("anchor_type"), F.when(F.expr("doc_id % 5 = 0"), "RETIRED").otherwise("ACTIVE").alias("status"))
    return cases, evidence.filter("span RLIKE '[^\\\\s*]'"), d


@query("SELECT doc_id AS case_id FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0")
def stale_cases(spark, sf_dir):
    return ev.stale_cases(*_cases(spark, sf_dir)).select("case_id")


@query("SELECT (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT doc_id % 300 FROM documents)) AS stale_annotations, (SELECT count(*) FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0) AS affected_cases")
def activation_impact(spark, sf_dir):
    annotations = view(spark, sf_dir, "events").select(F.col("event_id").alias("annotation_id"), F.col("user_id").alias("text_hash"))
    chunks = view(spark, sf_dir, "documents").select(F.expr("doc_id % 300").alias("text_hash"))
    return ev.activation_impact(annotations, chunks, ev.stale_cases(*_cases(spark, sf_dir)))
