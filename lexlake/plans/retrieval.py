"""Queries of recall, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.operators import access, fusion, graph, recall
from lexlake.plans.registry import query, view

TERMS = "the and tion"
_BM25 = r"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}0-9]+')) AS term FROM documents),
dl AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tok t USING (doc_id) GROUP BY 1),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN ('the', 'and', 'tion') GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm)"""
_COS = """
q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
cs AS (SELECT vec_id, round(greatest(0, least(1, (list_sum(list_transform(list_zip(embedding, qv), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(qv, lambda x: x::DOUBLE * x::DOUBLE)))) + 1) / 2)), 6) AS score FROM embeddings, q),
c AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM cs)"""


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, TERMS)], "query_id long, text string")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return v, v.filter("chunk_id = 0").select(F.lit(0).cast("long").alias("query_id"), "vector")


@query(f"WITH {_BM25} SELECT doc_id AS chunk_id, round(score, 6) AS score, rank FROM b WHERE rank <= 50")
def bm25_top50(spark, sf_dir):
    return recall.bm25(_docs(spark, sf_dir), _queries(spark), 50).drop("query_id")


@query(f"WITH {_COS} SELECT vec_id AS chunk_id, score, rank FROM c WHERE rank <= 50")
def vector_top50(spark, sf_dir):
    return recall.vector_search(*_vectors(spark, sf_dir), k=50).drop("query_id")


@query("""
WITH q AS (SELECT vec_id % 3 AS query_id, embedding AS qv FROM embeddings WHERE vec_id < 6),
s AS (SELECT query_id, vec_id, max(round(greatest(0, least(1, (list_sum(list_transform(list_zip(embedding, qv), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(qv, lambda x: x::DOUBLE * x::DOUBLE)))) + 1) / 2)), 6)) AS score FROM embeddings, q GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id AS chunk_id, score, rank FROM r WHERE rank <= 20""")
def multimodal_top20(spark, sf_dir):
    v, _ = _vectors(spark, sf_dir)
    return recall.multimodal_search(v, v.filter("chunk_id < 6").select(F.expr("chunk_id % 3").alias("query_id"), "vector"), 20)


@query(f"""WITH {_BM25}, {_COS},
r AS (SELECT doc_id AS id, rank FROM b WHERE rank <= 50 UNION ALL SELECT vec_id, rank FROM c WHERE rank <= 50),
f AS (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS s FROM r GROUP BY id),
p AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS position FROM f)
SELECT id AS chunk_id, round(s, 6) AS fused_score, position FROM p WHERE position <= 5""")
def hybrid_rrf_topn(spark, sf_dir):
    routes = recall.bm25(_docs(spark, sf_dir), _queries(spark), 50).withColumn("route", F.lit("BM25")).unionByName(recall.vector_search(*_vectors(spark, sf_dir), k=50).withColumn("route", F.lit("VECTOR")))
    fused = fusion.rrf(routes.drop("rank"))
    return fusion.top_n(fused, 5).select("chunk_id", "fused_score", "position")


_RANK = "SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC, chunk_id) AS rank, CASE route WHEN 'VECTOR' THEN 1 WHEN 'BM25' THEN 2 WHEN 'MULTIMODAL' THEN 3 ELSE 4 END AS o FROM {route}"


@query(f"WITH r AS ({_RANK}), f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS s, arg_min(route, rank * 10 + o) AS primary_source FROM r GROUP BY 1, 2) SELECT query_id, chunk_id, round(s, 6) AS fused_score, primary_source FROM f")
def rrf_fusion(spark, sf_dir):
    return fusion.rrf(view(spark, sf_dir, "route")).select("query_id", "chunk_id", "fused_score", "primary_source")


@query(f"""WITH r AS ({_RANK}), m AS (SELECT *, min(score) OVER (PARTITION BY query_id, route) AS lo, max(score) OVER (PARTITION BY query_id, route) AS hi FROM r),
n AS (SELECT *, CASE WHEN hi - lo <= 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS norm FROM m)
SELECT query_id, chunk_id, round(sum(CASE route WHEN 'VECTOR' THEN 0.7 WHEN 'BM25' THEN 0.3 ELSE 0 END * norm), 6) AS fused_score, arg_min(route, rank * 10 + o) AS primary_source FROM n GROUP BY 1, 2""")
def weighted_fusion(spark, sf_dir):
    return fusion.weighted_fusion(view(spark, sf_dir, "route"), 0.7).select("query_id", "chunk_id", "fused_score", "primary_source")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY fused_score DESC, chunk_id) AS k FROM {ranked}) SELECT query_id, kb_id, chunk_id, round(1.0 / (60 + k), 6) AS fused_score, row_number() OVER (PARTITION BY query_id ORDER BY k, chunk_id) AS position FROM r")
def cross_kb_rrf(spark, sf_dir):
    return fusion.cross_kb_rrf(view(spark, sf_dir, "ranked")).select("query_id", "kb_id", "chunk_id", "fused_score", "position")


@query("""WITH b AS (SELECT n_regionkey AS r, CAST(n_nationkey % 4 AS BIGINT) AS w0, n_nationkey AS o FROM nation),
w AS (SELECT r, o, CASE WHEN w0 > 0 THEN w0 ELSE 1 END AS w FROM b), q AS (SELECT *, floor(50 * w / sum(w) OVER (PARTITION BY r))::BIGINT AS q0, row_number() OVER (PARTITION BY r ORDER BY w DESC, o) AS k FROM w)
SELECT o AS decl_order, CAST(q0 + CASE WHEN k = 1 THEN 50 - sum(q0) OVER (PARTITION BY r) ELSE 0 END AS BIGINT) AS quota FROM q""")
def kb_quota(spark, sf_dir):
    bases = view(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("request"), F.col("n_nationkey").alias("kb_id"), F.expr("n_nationkey % 4").alias("weight"), F.col("n_nationkey").alias("decl_order"))
    return fusion.kb_quota(bases, 50, "request").select("decl_order", "quota")


@query(f"""WITH r AS ({_RANK}), f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS s, max(score) FILTER (WHERE route = 'VECTOR') AS vs, max(rank) FILTER (WHERE route = 'VECTOR') AS vr, max(score) FILTER (WHERE route = 'BM25') AS bs, max(rank) FILTER (WHERE route = 'BM25') AS br FROM r GROUP BY 1, 2)
SELECT query_id, chunk_id, round(s, 6) AS fused_score, round(vs, 6) AS vector_score, vr::DOUBLE AS vector_rank, round(bs, 6) AS bm25_score, br::DOUBLE AS bm25_rank, 1 + (vs IS NOT NULL)::INT * 2 + (bs IS NOT NULL)::INT * 2 AS keys FROM f""")
def hit_scores(spark, sf_dir):
    """What is said of each hit's scores: those of the routes that found it."""
    fused = fusion.rrf(view(spark, sf_dir, "route"))
    said = fused.select("query_id", "chunk_id", access.score_metadata(fused).alias("m"))
    return said.select("query_id", "chunk_id", *(F.col("m")[k].alias(k) for k in ("fused_score", "vector_score", "vector_rank", "bm25_score", "bm25_rank")), F.size("m").alias("keys"))


#: Requests to which one, two or three bases contribute.
_SOME = "SELECT query_id, CASE WHEN query_id % 5 = 3 THEN 'kb1' WHEN query_id % 5 = 4 AND kb_id = 'kb1' THEN 'kb2' ELSE kb_id END AS kb_id, chunk_id, fused_score FROM {ranked}"


@query(f"""WITH k AS ({_SOME}), b(kb_id, w, o) AS (VALUES ('kb0', 2, 0), ('kb1', 1, 1), ('kb2', 1, 2), ('kb9', 5, 3)), c AS (SELECT DISTINCT query_id, kb_id FROM k),
q AS (SELECT *, floor(50 * w / sum(w) OVER (PARTITION BY query_id)) AS q0, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, o) AS i, count(*) OVER (PARTITION BY query_id) AS n FROM c JOIN b USING (kb_id)),
a AS (SELECT query_id, kb_id, n, q0 + CASE WHEN i = 1 THEN 50 - sum(q0) OVER (PARTITION BY query_id) ELSE 0 END AS quota FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY fused_score DESC, chunk_id) AS r FROM k), s AS (SELECT query_id, kb_id, chunk_id, CASE WHEN n = 1 THEN fused_score ELSE 1.0 / (60 + r) END AS s FROM r JOIN a USING (query_id, kb_id) WHERE n = 1 OR r <= quota)
SELECT query_id, kb_id, chunk_id, round(s, 6) AS fused_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS position FROM s""")
def merge_across_kbs(spark, sf_dir):
    bases = spark.createDataFrame([("kb0", 2, 0), ("kb1", 1, 1), ("kb2", 1, 2), ("kb9", 5, 3)], "kb_id string, weight int, decl_order int")
    ranked = spark.sql(_SOME, ranked=view(spark, sf_dir, "ranked"))
    return fusion.merge_across_kbs(ranked, bases, 50).select("query_id", "kb_id", "chunk_id", "fused_score", "position")


_HYBRID = """c AS (SELECT *, coalesce(bm25_score, 0) AS b FROM {candidate}), m AS (SELECT *, min(b) OVER (PARTITION BY query_id) AS lo, max(b) OVER (PARTITION BY query_id) AS hi FROM c),
h AS (SELECT *, 0.7 * rerank_score + 0.3 * CASE WHEN hi - lo <= 1e-9 THEN 0.0 ELSE (b - lo) / (hi - lo) END AS hybrid_score FROM m)"""


def _hybrid(spark, sf_dir):
    return fusion.hybrid_order(view(spark, sf_dir, "candidate"), 0.7, 0.3).withColumn("ordering_score", fusion.ordering_score())


@query(f"WITH {_HYBRID} SELECT query_id, chunk_id, round(hybrid_score, 6) AS hybrid_score, round(coalesce(hybrid_score, rerank_score, fused_score), 6) AS ordering_score FROM h")
def hybrid_order(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "chunk_id", "hybrid_score", "ordering_score")


_UNITS = _HYBRID + """, u AS (SELECT query_id, coalesce(parent_id, chunk_id) AS unit_id, max(hybrid_score) AS s, arg_max(chunk_id, hybrid_score) AS best, string_agg(chunk_id, ',' ORDER BY hybrid_score DESC, chunk_id) AS members FROM h GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, unit_id) AS position FROM u)"""


@query(f"WITH {_UNITS} SELECT query_id, unit_id, round(s, 6) AS unit_score, members, position FROM p")
def parent_child_merge(spark, sf_dir):
    return fusion.merge_parents(_hybrid(spark, sf_dir)).select("query_id", "unit_id", "unit_score", F.array_join("members", ",").alias("members"), "position")


def _best(spark, sf_dir):
    """Units with what their best chunk has. The SQL's arg_max keeps the first of equal rows: that of the least order, by number and not by text."""
    units = fusion.merge_parents(_hybrid(spark, sf_dir).withColumn("place", F.expr("CAST(substr(chunk_id, 2) AS BIGINT)")), first="place")
    best = _hybrid(spark, sf_dir).select("query_id", F.col("chunk_id").alias("best"), "vector_score", "rerank_score", "bm25_score", "fused_score", "content_length")
    return units.join(best, ["query_id", "best"])


@query(f"WITH {_UNITS} SELECT p.query_id, unit_id, position, round(coalesce(x.vector_score, 0), 6) AS score FROM p JOIN {{candidate}} x ON p.query_id = x.query_id AND p.best = x.chunk_id WHERE x.vector_score >= 0.5")
def score_threshold(spark, sf_dir):
    kept = fusion.apply_threshold(_best(spark, sf_dir), 0.5, fusion.threshold_target(False, True))
    score, _ = fusion.reported_score("COSINE", "RRF", threshold_active=True)
    return kept.select("query_id", "unit_id", "position", score.alias("score"))


@query(f"""WITH {_UNITS}, t AS (SELECT p.query_id, p.unit_id, p.position, x.content_length, sum(x.content_length) OVER (PARTITION BY p.query_id ORDER BY p.position) AS run FROM p JOIN {{candidate}} x ON p.query_id = x.query_id AND p.best = x.chunk_id WHERE position <= 20)
SELECT query_id, unit_id, position FROM t WHERE run <= 900 OR position = 1""")
def content_budget(spark, sf_dir):
    return fusion.content_budget(fusion.top_n(_best(spark, sf_dir), 20), 900, F.col("content_length")).select("query_id", "unit_id", "position")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, chunk_id) AS position FROM {candidate}), k AS (SELECT *, coalesce(parent_id, chunk_id) AS unit FROM p WHERE position <= 50),
n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, unit ORDER BY position) = 1 THEN 1 ELSE 0 END AS new FROM k),
b AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT query_id, chunk_id, position FROM b WHERE before < 20""")
def select_candidates(spark, sf_dir):
    from pyspark.sql import Window as W

    ranked = view(spark, sf_dir, "candidate").withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("fused_score").desc(), "chunk_id")))
    return fusion.select_candidates(ranked, 50, top_n=5).select("query_id", "chunk_id", "position")


@query("""WITH s AS (SELECT *, match_score / (1 + hops) AS rel FROM {trace}), o AS (SELECT query_id, chunk_id, entity_name, max(rel) AS rel, -max(rel * 1000 - hops / 100.0) AS k, arg_max(hops, rel * 1000 - hops / 100.0) AS hops FROM s GROUP BY 1, 2, 3),
b AS (SELECT query_id, chunk_id, max(rel) AS score, arg_max(hops, rel * 1000 - hops / 100.0) AS hops, array_to_string(list(entity_name ORDER BY rel DESC, entity_name)[1:5], ',') AS entities FROM o GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position FROM b) SELECT query_id, chunk_id, round(score, 6) AS score, CAST(hops AS BIGINT) AS hops, entities, position FROM p WHERE position <= 50""")
def graph_relevance(spark, sf_dir):
    return fusion.graph_relevance(view(spark, sf_dir, "trace")).select("query_id", "chunk_id", "score", "hops", F.array_join("entities", ",").alias("entities"), "position")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {edge}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(seed, node, hops) AS (SELECT x, x, 0 FROM (VALUES (20), (41)) t(x) UNION SELECT w.seed, u.dst, w.hops + 1 FROM w JOIN u ON u.src = w.node WHERE w.hops < 2)
SELECT CAST(seed AS BIGINT) AS seed, CAST(node AS BIGINT) AS node, CAST(min(hops) AS BIGINT) AS hops FROM w GROUP BY 1, 2""")
def graph_reach(spark, sf_dir):
    return graph.reach(view(spark, sf_dir, "edge"), spark.createDataFrame([(20, 20), (41, 41)], "seed long, node long"), 2)


@query("""WITH e AS (SELECT DISTINCT src AS entity FROM {edge}), r AS (SELECT src AS entity, array_to_string(list(DISTINCT type || ':' || dst ORDER BY type || ':' || dst)[1:20], ',') AS rel FROM {edge} GROUP BY 1),
m AS (SELECT entity, count(DISTINCT chunk_id) AS c FROM {mention} GROUP BY 1) SELECT e.entity, coalesce(m.c, 0) AS chunk_count, rel AS relations FROM e LEFT JOIN m USING (entity) LEFT JOIN r USING (entity)""")
def graph_entities(spark, sf_dir):
    edges = view(spark, sf_dir, "edge")
    entities = edges.select(F.col("src").alias("entity"), F.col("src").cast("string").alias("name")).distinct()
    out = graph.entity_listing(entities, edges, view(spark, sf_dir, "mention"))
    return out.select("entity", "chunk_count", F.array_join("relations", ",").alias("relations"))


@query("SELECT (SELECT count(DISTINCT src) FROM {edge}) AS entities, (SELECT count(*) FROM {edge}) AS relations, (SELECT count(DISTINCT chunk_id) FROM {mention}) AS chunks")
def graph_summary(spark, sf_dir):
    edges = view(spark, sf_dir, "edge")
    return graph.summary(edges.select(F.col("src").alias("entity")), edges, view(spark, sf_dir, "mention"))


@query("SELECT doc_id FROM {document} WHERE current_version IS NOT NULL AND NOT trashed AND publish_status = 'PUBLISHED' AND (effective_at IS NULL OR effective_at <= 50) AND (expires_at IS NULL OR expires_at > 50)")
def visible_versions(spark, sf_dir):
    return recall.visible_versions(view(spark, sf_dir, "document"), F.lit(50)).select("doc_id")


@query("SELECT chunk_id FROM {chunk} WHERE kb_id = 'kb1' AND enabled AND document_version_id IN (SELECT current_version FROM {document} WHERE publish_status = 'PUBLISHED')")
def recall_filter(spark, sf_dir):
    versions = view(spark, sf_dir, "document").filter("publish_status = 'PUBLISHED'").select(F.col("current_version").alias("document_version_id"))
    return recall.recall_filter(view(spark, sf_dir, "chunk"), "kb1", versions).select("chunk_id")


@query("SELECT chunk_id FROM {chunk} WHERE sender = 'src4' AND msg_time >= 100000 AND msg_time <= 500000 AND (doc_id % 2 = 0 OR doc_id % 3 = 1) AND doc_id % 2 = 0")
def metadata_filter(spark, sf_dir):
    tagged = view(spark, sf_dir, "chunk").withColumn("tag_ids", F.array(F.concat(F.lit("a"), F.expr("doc_id % 2")), F.concat(F.lit("b"), F.expr("doc_id % 3")))).withColumn("ext_group", F.array(F.concat(F.lit("x"), F.expr("1 - doc_id % 2"))))
    return recall.metadata_filter(tagged, ["a0", "b1"], sender="src4", since=100000, until=500000, custom={"group": "x1"}).select("chunk_id")


@query("SELECT doc_id FROM {document} WHERE visibility <> 'RESTRICTED' OR doc_id % 8 = 0")
def acl_trim(spark, sf_dir):
    docs = view(spark, sf_dir, "document")
    return recall.trim_restricted(docs, docs.filter("doc_id % 8 = 0").select("doc_id", F.lit("r1").alias("role_id")), ["r1", "r2"]).select("doc_id")


@query("SELECT r.query_id, r.chunk_id FROM {route} r WHERE r.chunk_id IN (SELECT chunk_id FROM {chunk} WHERE enabled)")
def drop_disabled(spark, sf_dir):
    kept, _ = recall.drop_orphans(view(spark, sf_dir, "route"), view(spark, sf_dir, "chunk"))
    return kept.select("query_id", "chunk_id")


@query("""WITH d AS (SELECT concat('c', CAST(doc_id AS STRING)) AS chunk_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}0-9]+')) AS t FROM documents)
SELECT chunk_id, round(len(list_intersect(t, ['the', 'and', 'tion'])) / 3.0, 6) AS rerank_score FROM d""")
def lexical_rerank(spark, sf_dir):
    return fusion.lexical_rerank(view(spark, sf_dir, "chunk").select("chunk_id", F.col("content").alias("text"), F.lit(TERMS).alias("query"))).select("chunk_id", "rerank_score")
