"""Queries of chunk edits, governance, keyed tables and chat pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.operators import edits, governance, keyed, semantic
from lexlake.plans.registry import query, view
from lexlake.sources import chat_pages, images
from lexlake.storage import scratch_path

#: Documents as chunks of twenty to a version: every fifth is the parent of the four after it, some name a parent that isn't there.
_CHUNK = """SELECT concat('c', CAST(doc_id AS STRING)) AS chunk_id, CAST(floor(doc_id / 20) AS BIGINT) AS doc_id, concat('v', CAST(CAST(floor(doc_id / 20) AS BIGINT) AS STRING)) AS version_id,
CASE WHEN doc_id % 5 > 0 THEN concat('c', CAST(doc_id - doc_id % 5 AS STRING)) WHEN doc_id % 17 = 0 THEN 'gone' END AS parent_id, doc_id % 20 AS seq, text AS content,
CASE WHEN doc_id % 9 > 0 THEN doc_id % 4 > 0 END AS enabled FROM {documents}"""
_COPIES = "SELECT DISTINCT doc_id, version_id AS from_version, concat(version_id, '.b') AS to_version FROM {chunk_rows} WHERE doc_id % 3 = 0 UNION ALL SELECT DISTINCT doc_id, version_id, concat(version_id, '.c') FROM {chunk_rows} WHERE doc_id % 6 = 0"


def _new(*parts: str) -> str:
    """derived_id in DuckDB."""
    return f"concat('c', left(sha256(concat_ws(chr(31), {', '.join(parts)})), 32))"


def _chunks(spark, sf_dir):
    return spark.sql(_CHUNK, documents=view(spark, sf_dir, "documents"))


@query(f"""WITH k AS ({_CHUNK}), c AS ({_COPIES.replace("{chunk_rows}", "k")}), o AS (SELECT k.*, to_version FROM k JOIN c ON k.doc_id = c.doc_id AND k.version_id = c.from_version)
SELECT {_new("o.to_version", "o.chunk_id")} AS chunk_id, CASE WHEN p.chunk_id IS NOT NULL THEN {_new("o.to_version", "o.parent_id")} END AS parent_id, o.to_version AS version_id, o.seq, coalesce(o.enabled, true) AS enabled,
o.chunk_id NOT IN (SELECT parent_id FROM k WHERE parent_id IS NOT NULL) AS indexable FROM o LEFT JOIN k p ON p.chunk_id = o.parent_id AND p.version_id = o.version_id""")
def copy_chunks(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return edits.copy_chunks(chunks, spark.sql(_COPIES, chunk_rows=chunks)).select("chunk_id", "parent_id", "version_id", "seq", "enabled", "indexable")


_OFFSETS = "CASE WHEN n % 4 = 1 THEN [10, 20] WHEN n % 8 = 3 THEN [5] WHEN n % 16 = 7 THEN [7, 7] WHEN n % 10 = 0 THEN [3, 6, 9] END"


@query(f"""WITH k AS (SELECT *, substr(chunk_id, 2)::BIGINT AS n, length(coalesce(content, '')) AS l FROM ({_CHUNK})), s AS (SELECT *, {_OFFSETS} AS o FROM k),
v AS (SELECT *, CASE WHEN o[-1] < l AND n % 16 <> 7 THEN o END AS cut FROM s),
m AS (SELECT *, seq + coalesce(sum(coalesce(len(cut), 0)) OVER (PARTITION BY version_id, parent_id ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM v),
e AS (SELECT *, list_concat([0], coalesce(cut, []), [l]) AS edges FROM m WHERE parent_id IS NULL OR parent_id NOT IN (SELECT chunk_id FROM v WHERE cut IS NOT NULL)),
p AS (SELECT *, unnest(range(len(edges) - 1)) AS i FROM e)
SELECT CASE WHEN cut IS NULL THEN chunk_id ELSE {_new("chunk_id", "edges[i + 1]::VARCHAR")} END AS chunk_id, version_id, parent_id, (place + i)::BIGINT AS seq,
md5(CASE WHEN cut IS NULL THEN content ELSE substr(content, edges[i + 1] + 1, edges[i + 2] - edges[i + 1]) END) AS content, enabled, CASE WHEN cut IS NOT NULL THEN i END AS part FROM p""")
def split_chunks(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    n = F.expr("CAST(substr(chunk_id, 2) AS BIGINT)")
    array = lambda *x: F.array(*map(F.lit, x))
    offsets = F.when(n % 4 == 1, array(10, 20)).when(n % 8 == 3, array(5)).when(n % 16 == 7, array(7, 7)).when(n % 10 == 0, array(3, 6, 9))
    out = edits.split_chunks(chunks, chunks.select("chunk_id", offsets.alias("offsets")).filter("offsets IS NOT NULL"))
    return out.select("chunk_id", "version_id", "parent_id", "seq", F.md5("content").alias("content"), "enabled", "part")


_MERGED = "SELECT chunk_id, CASE WHEN doc_id % 2 = 0 THEN concat('m', parent_id) ELSE concat('n', CAST(doc_id AS STRING), '-', CAST(seq % 3 AS STRING)) END AS merge_id FROM {chunk_rows} WHERE seq % 5 IN (1, 2, 3) OR doc_id % 2 = 1"


@query(f"""WITH k AS ({_CHUNK}), m AS ({_MERGED.replace("{chunk_rows}", "k")}), g AS (SELECT merge_id, k.*, k.seq - lag(k.seq) OVER (PARTITION BY merge_id ORDER BY k.seq) AS gap FROM m JOIN k USING (chunk_id)),
h AS (SELECT merge_id, count(*) AS n, min(coalesce(gap, 1)) AS lo, max(coalesce(gap, 1)) AS hi, count(DISTINCT coalesce(parent_id, '')) AS parents, min(parent_id) AS parent_id, min(seq) AS seq, string_agg(coalesce(content, ''), chr(10) ORDER BY seq) AS content,
bool_or(coalesce(enabled, false)) AS enabled, string_agg(chunk_id, ',' ORDER BY seq) AS ids FROM g GROUP BY 1)
SELECT {_new("ids")} AS chunk_id, parent_id, seq, md5(content) AS content, enabled, ids FROM h WHERE n >= 2 AND lo = 1 AND hi = 1 AND parents = 1""")
def merge_chunks(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    out = edits.merge_chunks(chunks, spark.sql(_MERGED, chunk_rows=chunks))
    return out.select("chunk_id", "parent_id", "seq", F.md5("content").alias("content"), "enabled", F.array_join("chunk_ids", ",").alias("ids"))


_TOGGLES = "SELECT event_id AS id, concat('c', CAST(user_id AS STRING)) AS chunk_id, event_id % 3 > 0 AS enabled FROM {events}"


@query(f"""WITH k AS ({_CHUNK}), t AS ({_TOGGLES}), b AS (SELECT id, chunk_id, enabled, false AS of_parent FROM t UNION ALL SELECT t.id, k.chunk_id, t.enabled, true FROM k JOIN t ON t.chunk_id = k.parent_id),
l AS (SELECT chunk_id, arg_max(enabled, id) AS new, max(id) AS id, arg_max(of_parent, id) AS of_parent FROM b GROUP BY 1)
SELECT chunk_id, coalesce(new, enabled) AS enabled, CASE WHEN new IS DISTINCT FROM enabled AND new IS NOT NULL THEN id END AS changed_by, CASE WHEN new IS DISTINCT FROM enabled AND new IS NOT NULL THEN of_parent END AS cascaded FROM k LEFT JOIN l USING (chunk_id)""")
def toggle_chunks(spark, sf_dir):
    return edits.toggle_chunks(_chunks(spark, sf_dir), spark.sql(_TOGGLES, events=view(spark, sf_dir, "events"))).select("chunk_id", "enabled", "changed_by", "cascaded")


_LOG = """SELECT user_id AS doc_id, event_id, CASE WHEN event_id % 13 < 3 THEN 'SUBMIT' WHEN event_id % 13 < 5 THEN 'APPROVE' WHEN event_id % 13 = 5 THEN 'REJECT' WHEN event_id % 13 < 8 THEN 'VALIDITY' WHEN event_id % 13 < 10 THEN 'TRASH'
WHEN event_id % 13 < 12 THEN 'RESTORE' WHEN event_id % 8 = 0 THEN 'PURGE' ELSE 'odd' END AS op, event_id AS at, concat('n', CAST(event_id AS STRING)) AS note, CASE WHEN event_id % 3 > 0 THEN event_id % 10 END AS effective_at,
CASE WHEN event_id % 4 > 0 THEN event_id % 7 END AS expires_at FROM {events}"""


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY event_id) AS n FROM ({_LOG})),
f AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS op, NULL::VARCHAR AS refused, 'DRAFT' AS publish_status, NULL::VARCHAR AS review_note, NULL::BIGINT AS effective_at, NULL::BIGINT AS expires_at, false AS trashed, NULL::BIGINT AS trashed_at, false AS purged FROM l
UNION ALL SELECT doc_id, n, event_id, op, why, CASE WHEN why IS NULL AND op = 'SUBMIT' THEN 'PENDING_REVIEW' WHEN why IS NULL AND op = 'APPROVE' THEN 'PUBLISHED' WHEN why IS NULL AND op = 'REJECT' THEN 'REJECTED' ELSE publish_status END,
  CASE WHEN why IS NULL AND op = 'APPROVE' THEN NULL WHEN why IS NULL AND op = 'REJECT' THEN note ELSE review_note END, CASE WHEN why IS NULL AND op = 'VALIDITY' THEN e2 ELSE effective_at END, CASE WHEN why IS NULL AND op = 'VALIDITY' THEN x2 ELSE expires_at END,
  CASE WHEN why IS NULL AND op IN ('TRASH', 'RESTORE') THEN op = 'TRASH' ELSE trashed END, CASE WHEN why IS NULL AND op = 'TRASH' THEN "at" WHEN why IS NULL AND op = 'RESTORE' THEN NULL ELSE trashed_at END, purged OR why IS NULL AND op = 'PURGE'
  FROM (SELECT f.doc_id, l.n, l.event_id, l.op, l.at, l.note, l.effective_at AS e2, l.expires_at AS x2, f.publish_status, f.review_note, f.effective_at, f.expires_at, f.trashed, f.trashed_at, f.purged,
    CASE WHEN f.purged THEN 'NOT_FOUND' WHEN l.op = 'VALIDITY' AND l.effective_at >= l.expires_at THEN 'EMPTY_WINDOW' WHEN l.op IN ('RESTORE', 'PURGE') THEN CASE WHEN NOT f.trashed THEN 'NOT_IN_TRASH' END WHEN f.trashed THEN 'IN_TRASH'
    WHEN l.op = 'SUBMIT' THEN CASE WHEN f.publish_status NOT IN ('DRAFT', 'REJECTED') THEN 'WRONG_STATUS' END WHEN l.op IN ('APPROVE', 'REJECT') THEN CASE WHEN f.publish_status <> 'PENDING_REVIEW' THEN 'WRONG_STATUS' END WHEN l.op NOT IN ('VALIDITY', 'TRASH') THEN 'UNKNOWN' END AS why
    FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1))
SELECT doc_id, event_id, op, refused, publish_status, review_note, effective_at, expires_at, trashed, trashed_at, purged FROM f WHERE n > 0""")
def governance_log(spark, sf_dir):
    return governance.fold_log(spark.sql(_LOG, events=view(spark, sf_dir, "events")))


_BATCH = "SELECT user_id AS chunk_id, CAST(floor(value) AS BIGINT) AS seq, event_type AS v, event_id AS id, CASE WHEN event_id % 10 < 7 THEN 0 ELSE event_id % 10 - 6 END AS batch FROM {events}"


@query(f"SELECT chunk_id, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC, batch DESC, id DESC) AS r FROM ({_BATCH})) WHERE r = 1")
def keyed_table(spark, sf_dir):
    """All events laid over a keyed table in four batches, the second of them twice."""
    rows = spark.sql(_BATCH, events=view(spark, sf_dir, "events"))
    table = keyed.KeyedTable(spark, scratch_path(spark, "keyed"), "chunk_id", "seq", 8)
    for n in (0, 1, 2, 1, 3):
        best = rows.filter(F.col("batch") == n).groupBy("chunk_id").agg(F.max_by(F.struct("seq", "v"), F.struct("seq", "id")).alias("b"))
        table.lay(best.select("chunk_id", "b.*"), n)
    return table.read()


@query("""WITH t AS (SELECT doc_id, arg_max(version_id, id) AS t FROM {version} WHERE id % 3 <> 0 GROUP BY 1) SELECT id, CASE WHEN version_id = t THEN 'ACTIVE' WHEN t IS NOT NULL AND status = 'ACTIVE' THEN 'READY' ELSE status END AS status FROM {version} LEFT JOIN t USING (doc_id)""")
def activation_pointers(spark, sf_dir):
    """Versions activated in two batches of pointers, the later ones over the earlier."""
    versions = view(spark, sf_dir, "version")
    pointers = keyed.KeyedTable(spark, scratch_path(spark, "pointers"), "doc_id", "seq", 8)
    for n in (1, 2):
        pointers.lay(versions.filter(F.col("id") % 3 == n).groupBy("doc_id").agg(F.max_by("version_id", "id").alias("version_id"), F.max("id").alias("seq")), n)
    return keyed.with_active(versions, pointers.read()).select("id", "status")


def _chat_pages(spark, sf_dir):
    """Conversations as exported pages: voice, video and image messages among them, and some without a time."""
    kind = F.expr("(conv_id + turn) % 7")
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    inside = F.when(kind == 0, F.lit("<audio src='a'></audio>")).when(kind == 1, F.lit("<video>x</video>")).otherwise(F.concat(F.lit("<div class='content wide'>"), escaped, F.when(kind == 2, F.lit("<img src=x>")).otherwise(""), F.lit("</div>")))
    time = F.when(F.expr("(conv_id * 3 + turn) % 11 = 0"), "soon").otherwise(F.date_format(F.timestamp_millis(F.lit(1704067200000) + F.col("turn") * 60_000), "yyyy-MM-dd HH:mm:ss"))
    message = F.concat(F.lit("<div class=message><span class=sender>"), F.col("role"), F.lit("</span> <span class=time>"), time, F.lit("</span>"), inside, F.lit("</div>\n"))
    held = view(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("l"))
    page = F.concat(F.lit("<html><style>.x{}</style><body>"), F.array_join(F.transform("l", lambda x: x["m"]), ""), F.lit("</body></html>"))
    return chat_pages.read_chat_pages(held.select("session_id", page.alias("html")))


_TIMED = "SELECT *, (conv_id + turn) % 7 AS k, (conv_id * 3 + turn) % 11 > 0 AS timed FROM conversations"


@query(f"SELECT conv_id AS session_id, concat(conv_id, '-', row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS msg_id, role AS sender, 1704067200000 + turn * 60000 AS send_time, CASE WHEN k = 2 THEN 'image' ELSE 'text' END AS msg_type, md5(CASE WHEN k = 2 THEN '[IMAGE]' ELSE trim(text) END) AS h FROM ({_TIMED}) WHERE k > 1 AND timed")
def chat_page_messages(spark, sf_dir):
    return _chat_pages(spark, sf_dir).select("session_id", F.explode("messages").alias("m")).select("session_id", "m.msg_id", "m.sender", "m.send_time", "m.msg_type", F.md5("m.content").alias("h"))


@query(f"SELECT conv_id AS session_id, count(*) FILTER (WHERE k = 0) AS voice, count(*) FILTER (WHERE k = 1) AS video, count(*) FILTER (WHERE k > 1 AND NOT timed) AS other, false AS failed FROM ({_TIMED}) GROUP BY 1")
def chat_page_skips(spark, sf_dir):
    return _chat_pages(spark, sf_dir).select("session_id", "skipped.*", "failed")


_IMAGE = "SELECT page_id, i, concat('image-', CAST((page_id * i) % 3 AS STRING), repeat('x', CASE WHEN (page_id + i) % 4 = 0 THEN 30 ELSE 0 END)) AS body FROM {pages} JOIN (VALUES (0), (1), (2), (3), (4)) AS t(i) ON i < page_id % 6"
_JUDGED = f"""f AS (SELECT page_id, body, min(i) AS place FROM ({_IMAGE}) GROUP BY 1, 2), b AS (SELECT *, length(body) <= 20 AS fits, coalesce(sum((length(body) <= 20)::INT) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)"""


def _images(spark, sf_dir):
    """Pages with up to five images as data in them, some alike and some too large; two are kept at most, of 20 bytes at most."""
    pages = view(spark, sf_dir, "pages")
    uri = F.concat(F.lit('<img src="data:image/png;base64,'), F.base64(F.encode(F.col("body"), "utf-8")), F.lit('">'))
    held = spark.sql(_IMAGE, pages=pages).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", uri.alias("u")))), lambda x: x["u"]), "\n").alias("u"))
    files = pages.join(held, "page_id", "left").select(F.col("page_id").alias("path"), F.lit("html").alias("kind"), F.encode(F.concat(F.coalesce("html", F.lit("")), F.coalesce("u", F.lit(""))), "utf-8").alias("content"))
    return images.collect_images(images.list_images(files), 2, 20)


@query(f"WITH {_JUDGED} SELECT page_id, place, concat('img_', before + 1) AS image_id, 'image/png' AS media_type, length(body) AS size, sha256(body) AS sha256, md5(body) AS content FROM b WHERE fits AND before < 2")
def image_assets(spark, sf_dir):
    return _images(spark, sf_dir)[0].withColumnRenamed("path", "page_id").withColumn("content", F.md5("content"))


@query(f"WITH {_JUDGED} SELECT page_id, place, CASE WHEN before >= 2 THEN 'IMAGE_COUNT' ELSE 'IMAGE_BYTES' END AS reason FROM b WHERE before >= 2 OR NOT fits")
def image_warnings(spark, sf_dir):
    return _images(spark, sf_dir)[1].withColumnRenamed("path", "page_id")


@query()
def split_semantic(spark, sf_dir):
    """Documents cut by answers of which some are of no use, by document and window."""
    docs = view(spark, sf_dir, "documents")
    kind = F.expr("pmod(doc_id + window_no, 5)")
    cut = F.col("shared") + F.expr("(units - shared) div 2")
    answer = F.when(kind == 0, F.concat(F.lit('{"cuts": ['), cut.cast("string"), F.lit("]}"))).when(kind == 1, '{"cuts": [5, 2]}').when(kind == 3, '```json\n{"cuts": [], "chunks": [{"title": "t"}]}\n```').when(kind == 4, "no")
    answers = semantic.semantic_windows(docs, 64).select("doc_id", "window_no", answer.alias("answer")).filter("answer IS NOT NULL")
    return semantic.split_semantic(docs, answers, 64).select("doc_id", "seq", "start", "stop", "tokens", "by_model", "title", F.md5("content").alias("content"))
