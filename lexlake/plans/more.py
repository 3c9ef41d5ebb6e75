"""Queries of memory, model answers, chat sources, and of Spark's own relational operators over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.operators import chat, fusion, memory, text
from lexlake.plans.registry import query, view

_NODES = "SELECT event_id AS id, concat('lib', CAST(event_id % 2 AS STRING)) AS library_id, CAST(user_id AS STRING) AS user_id, event_type AS rule_id, CASE WHEN event_id % 3 = 0 THEN event_id % 100 END AS expire_at FROM {events}"


def _nodes(spark, sf_dir):
    return spark.sql(_NODES, events=view(spark, sf_dir, "events"))


@query(f"SELECT id FROM ({_NODES}) WHERE (expire_at IS NULL OR expire_at > 50) AND library_id = 'lib1' AND rule_id = 'click'")
def memory_filter(spark, sf_dir):
    return memory.live(_nodes(spark, sf_dir), F.lit(50), library="lib1", rule="click").select("id")


@query(f"SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM ({_NODES}) WHERE expire_at IS NULL OR expire_at > 50) WHERE r <= 5")
def newest_memories(spark, sf_dir):
    return memory.newest(_nodes(spark, sf_dir), F.lit(50), 5).select("user_id", "id")


@query("SELECT query_id, chunk_id AS node_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM {candidate} WHERE rerank_score >= 0.5) WHERE rank <= 10")
def memory_search(spark, sf_dir):
    rows = view(spark, sf_dir, "candidate").select("query_id", F.col("chunk_id").alias("node_id"), memory.text_score(F.col("bm25_score")).alias("score"), "rerank_score")
    return memory.search(rows, 10, True, 0.5).select("query_id", "node_id", "rank")


_PROFILE = "SELECT doc_id, lang, source, substr(text, 1, CAST(doc_id % 3 * 256 + doc_id % 2 AS INT)) AS bio FROM {documents}"


@query(f"""WITH p AS (SELECT *, regexp_replace(bio, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS b FROM ({_PROFILE}))
SELECT doc_id, lang AS city, md5(CASE WHEN b <> '' AND length(b) <= 512 THEN b ELSE source END) AS bio, false AS other FROM p""")
def merge_profile(spark, sf_dir):
    """Heads of documents as values of up to 513 characters, over what is stored."""
    stored = F.create_map(F.lit("city"), F.lit("old"), F.lit("bio"), F.col("source"))
    new = F.create_map(F.lit(" city"), F.concat(F.lit("\n"), F.col("lang"), F.lit(" ")), F.lit("bio"), F.col("bio"), F.lit("other"), F.lit("y"))
    merged = spark.sql(_PROFILE, documents=view(spark, sf_dir, "documents")).select("doc_id", memory.merge_profile(stored, new, ["city", "bio", "age"]).alias("m"))
    return merged.select("doc_id", F.col("m")["city"].alias("city"), F.md5(F.col("m")["bio"]).alias("bio"), F.map_contains_key("m", "other").alias("other"))


_MEMORIES = """[{"event": "update", "node_id": " 7 ", "content": " a "}, {"event": "ADD", "content": " "}, {"event": "DELETE", "node_id": "9", "content": "d"}, {"content": "LONG"}, {"event": "UPDATE", "content": "n"}]"""


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' ELSE concat(CASE WHEN user_id % 2 = 0 AND event_id % 3 > 0 THEN 'UPDATE:7:a' ELSE 'ADD::a' END, ';ADD::d', CASE WHEN event_id % 5 > 0 THEN concat(';ADD::', repeat('x', 2000)) ELSE '' END, ';ADD::n') END AS c FROM events""")
def memory_commands(spark, sf_dir):
    long = F.repeat(F.lit("x"), F.when(F.expr("event_id % 5 = 0"), 2001).otherwise(2000))
    answer = F.concat(F.when(F.expr("event_id % 4 = 0"), '{"commands": ').otherwise('Sure: {"memories": '), F.replace(F.lit(_MEMORIES), F.lit("LONG"), long), F.lit("} done"))
    known = F.when(F.expr("user_id % 2 = 0"), F.array(F.lit("7"))).otherwise(F.array(F.lit("8")))
    lines = lambda found: F.array_join(F.transform(found, lambda c: F.concat(c["event"], F.lit(":"), F.coalesce(c["node_id"], F.lit("")), F.lit(":"), c["content"])), ";")
    allowed = F.when(F.expr("event_id % 3 = 0"), lines(memory.memory_commands(answer, known, False))).otherwise(lines(memory.memory_commands(answer, known)))
    return view(spark, sf_dir, "events").select("event_id", allowed.alias("c"))


@query("""SELECT event_id, CASE WHEN event_id % 6 NOT IN (0, 4) THEN concat('a:T', CASE WHEN event_id % 6 = 1 THEN '' ELSE concat(',', CASE WHEN event_id % 6 = 2 THEN repeat('n', 128) ELSE 'b' END, ':unknown') END) END AS entities,
CASE WHEN event_id % 6 NOT IN (0, 4) THEN CASE WHEN event_id % 6 IN (1, 2) THEN '' ELSE 'a-related_to-b' END END AS relations FROM events""")
def graph_extraction(spark, sf_dir):
    """Cases by event_id % 6: a name too long, a blank one, one of 128, plain, no entities, fenced."""
    kind = F.expr("event_id % 6")
    name = F.when(kind == 0, F.repeat(F.lit("n"), 129)).when(kind == 1, " ").when(kind == 2, F.repeat(F.lit("n"), 128)).otherwise(" b ")
    entities = F.concat(F.when(kind == 4, '"nodes"').otherwise('"entities"'), F.lit(': [{"name": "a", "type": "T"}, {"name": "a ", "type": "U"}, {"type": "V"}, {"name": "'), name, F.lit('"}]'))
    answer = F.concat(F.when(kind == 5, "```json\n").otherwise(""), F.lit("{"), entities, F.lit(', "relations": [{"source": "a", "target": " b"}, {"source": "a", "target": "z", "type": "r"}, {"source": "a"}]}'))
    g = view(spark, sf_dir, "events").select("event_id", memory.graph_extraction(answer).alias("g"))
    entities = F.array_join(F.transform("g.entities", lambda e: F.concat(e["name"], F.lit(":"), e["type"])), ",")
    return g.select("event_id", entities.alias("entities"), F.array_join(F.transform("g.relations", lambda r: F.concat_ws("-", r["source"], r["type"], r["target"])), ",").alias("relations"))


@query("SELECT event_id, least(coalesce(CASE WHEN event_id % 30 > 0 THEN event_id % 30 END, 5), 20) AS top_n, 'mode' AS rejected, CASE WHEN event_id % 2 = 0 THEN 'kb1,kb3' ELSE 'kb1,kb2,kb3' END AS routed, CASE WHEN event_id % 2 = 0 THEN 'a b' ELSE 'q' END AS rewritten FROM events")
def request_rules(spark, sf_dir):
    even = F.expr("event_id % 2 = 0")
    bases = F.array(*map(F.lit, ("kb1", "kb2", "kb3")))
    return view(spark, sf_dir, "events").select(
        "event_id", memory.setting(F.expr("event_id % 30"), F.lit(0), memory.DEFAULT_TOP_N, memory.MOST_TOP_N).alias("top_n"), F.array_join(memory.rejected_overrides(F.array(F.lit("top_n"), F.lit("mode"))), ",").alias("rejected"),
        F.array_join(memory.routed(F.when(even, '["kb3", "kb9", "kb1"]').otherwise("none"), bases), ",").alias("routed"), memory.rewritten(F.when(even, " a\n b ").otherwise(" "), F.lit("q")).alias("rewritten"),
    )


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'VECTOR_DOWN' END AS markers FROM events")
def degradation_markers(spark, sf_dir):
    mark = F.when(F.expr("event_id % 2 = 0"), "VECTOR_DOWN")
    joined = F.array_join(fusion.degradation_markers(mark, F.lit(None).cast("string"), mark), ",")
    return view(spark, sf_dir, "events").select("event_id", F.when(joined != "", joined).alias("markers"))


@query("SELECT doc_id, md5(concat('a ', chr(10), '[image] pic', CAST(doc_id AS STRING), chr(10), ' b ')) AS h FROM documents")
def image_placeholders(spark, sf_dir):
    proxies = F.create_map(F.lit("i1"), F.concat(F.lit("pic"), F.col("doc_id").cast("string")))
    return view(spark, sf_dir, "documents").select("doc_id", F.md5(text.resolve_placeholders(F.lit("a [[IMAGE:i1]] b [[IMAGE:zz]]"), proxies)).alias("h"))


@query("SELECT conv_id, md5(string_agg(concat('[', turn + 1, '] ', text), chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def prompt_passages(spark, sf_dir):
    held = view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return held.select("conv_id", F.md5(text.prompt_passages(F.transform("l", lambda x: x["text"]))).alias("h"))


@query("SELECT conv_id AS file, turn + 1 AS msg_no, role AS sender, md5(text) AS h FROM conversations WHERE NOT regexp_matches(text, '(^|\\n)\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2} \\S+(\\n|$)')")
def chat_txt_source(spark, sf_dir):
    m = chat.conversation_messages(view(spark, sf_dir, "conversations"))
    head = F.concat(F.date_format(F.timestamp_millis("send_time"), "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "sender")
    lines = m.select(F.col("session_id").alias("file"), "msg_no", F.posexplode(F.concat(F.array(head), F.split("content", "\n"))).alias("k", "line")).withColumn("line_no", F.col("msg_no") * 100_000 + F.col("k"))
    return chat.txt_messages(lines).select("file", "msg_no", "sender", F.md5("content").alias("h"))


@query("SELECT CAST(event_id AS STRING) AS msg_id, CAST(user_id AS STRING) AS sender, event_type AS content, CAST(ts AS STRING) IS NOT NULL AS timed FROM events")
def chat_columns(spark, sf_dir):
    raw = view(spark, sf_dir, "events").select(F.col("event_id").alias("Msg Id"), F.col("user_id").alias("SENDER"), F.col("event_type").alias("Content"), F.col("ts").alias("Create Time"))
    mapped = chat.map_columns(raw, {"msg_id": ["msgid"], "sender": ["from", "sender"], "content": ["content", "text"], "send_time": ["createtime"], "room": ["room"]})
    return mapped.select("msg_id", "sender", "content", F.col("send_time").isNotNull().alias("timed"))


#: Exports of a conversation each: every ninth begins with more lines than it has messages' own, so that it fails.
_TXT = """SELECT conv_id AS file, turn, role, concat('line ', CAST(turn AS STRING)) AS body, (conv_id + turn) % 6 AS k FROM {conversations}"""


def _txt(spark, sf_dir):
    t = spark.sql(_TXT, conversations=view(spark, sf_dir, "conversations"))
    time = F.date_format(F.timestamp_millis(F.lit(1704067200000) + F.col("turn") * 60_000), "yyyy-MM-dd HH:mm:ss")
    head = F.when(F.col("k") < 3, F.concat(time, F.lit(" "), "role")).when(F.col("k") < 5, F.concat("role", F.lit(" ("), time, F.lit("): now "))).otherwise(F.concat(F.lit("2024-99-99 00:00:00 "), "role"))
    junk = F.when(F.expr("turn = 0 AND file % 9 = 0"), F.array_repeat(F.lit("junk"), 500)).when(F.expr("turn = 0 AND file % 4 = 0"), F.array(F.lit("export"))).otherwise(F.array().cast("array<string>"))
    lines = t.select("file", "turn", F.posexplode(F.concat(junk, F.array(head, F.lit(" "), F.col("body"), F.lit("more ")))).alias("n", "line"))
    return chat.txt_sessions(lines.select("file", (F.col("turn") * 1000 + F.col("n")).alias("line_no"), "line"))


_LINES = f"""WITH t AS ({_TXT}), m AS (SELECT *, sum((k < 5)::INT) OVER (PARTITION BY file ORDER BY turn) AS msg_no FROM t),
f AS (SELECT file, count(*) * 3 + CASE WHEN file % 9 = 0 THEN 500 WHEN file % 4 = 0 THEN 1 ELSE 0 END AS lines, 2 * count(*) FILTER (WHERE msg_no = 0) + CASE WHEN file % 9 = 0 THEN 500 WHEN file % 4 = 0 THEN 1 ELSE 0 END AS unmatched,
count(*) FILTER (WHERE k = 5) AS skipped, unmatched / lines > 0.3 AS failed FROM m GROUP BY file)"""


@query(f"""{_LINES} SELECT file, concat(file, '-', msg_no) AS msg_id, arg_min(role, turn) AS sender, 1704067200000 + min(turn) * 60000 AS send_time,
trim(string_agg(CASE WHEN k IN (3, 4) THEN concat(' now ', chr(10)) ELSE '' END || body || chr(10) || 'more ', chr(10) ORDER BY turn)) AS content FROM m WHERE msg_no > 0 AND file IN (SELECT file FROM f WHERE NOT failed) GROUP BY file, msg_no""")
def chat_txt_messages(spark, sf_dir):
    return _txt(spark, sf_dir)[0]


@query(f"{_LINES} SELECT * FROM f")
def chat_txt_files(spark, sf_dir):
    return _txt(spark, sf_dir)[1]


_TABLE = """SELECT user_id % 50 AS file, event_id AS row_no, CASE WHEN event_id % 5 > 0 THEN concat(' s', CAST(event_id % 3 AS STRING)) END AS `Session`, CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS STRING) ELSE ' ' END AS `Msg Id`,
    CASE WHEN event_id % 29 > 0 THEN event_type END AS `TEXT`, CASE event_id % 7 WHEN 0 THEN 'voice' WHEN 1 THEN '43' WHEN 2 THEN ' Image ' WHEN 3 THEN '' ELSE 'text' END AS `type`, CASE WHEN event_id % 11 > 0 THEN CAST(1700000000 + event_id AS STRING) ELSE 'x' END AS `time`, 'yes' AS `Is Self` FROM {events}"""
_TABLE_COLUMNS = {"session_id": ["session"], "session_name": ["room"], "msg_id": ["id", "msgid"], "sender": ["from"], "is_self": ["isself"], "send_time": ["time"], "msg_type": ["type"], "content": ["text"]}


@query("""SELECT user_id % 50 AS file, CASE WHEN event_id % 5 > 0 THEN concat('s', event_id % 3) ELSE 'default' END AS session_id, session_id AS session_name, CASE WHEN event_id % 4 = 0 THEN event_id::VARCHAR ELSE concat(session_id, '-', event_id) END AS msg_id,
'' AS sender, true AS is_self, 1000 * (1700000000 + event_id) AS send_time, CASE WHEN event_id % 7 = 2 THEN 'image' ELSE 'text' END AS msg_type, CASE WHEN event_id % 29 > 0 THEN event_type ELSE '' END AS content FROM events WHERE event_id % 7 > 1 AND event_id % 11 > 0""")
def chat_table_messages(spark, sf_dir):
    return chat.table_messages(spark.sql(_TABLE, events=view(spark, sf_dir, "events")), _TABLE_COLUMNS)[0]


@query("SELECT user_id % 50 AS file, count(*) FILTER (WHERE event_id % 7 = 0) AS voice, count(*) FILTER (WHERE event_id % 7 = 1) AS video, count(*) FILTER (WHERE event_id % 7 > 1 AND event_id % 11 = 0) AS other FROM events GROUP BY 1")
def chat_table_skips(spark, sf_dir):
    return chat.table_messages(spark.sql(_TABLE, events=view(spark, sf_dir, "events")), _TABLE_COLUMNS)[1]


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, sf_dir):
    view(spark, sf_dir, "orders").createOrReplaceTempView("lexlake_orders")
    return spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM lexlake_orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@query("WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts AS t, event_id AS e FROM events WHERE event_type = 'view') SELECT a.event_id, max(b.e) AS last_view FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.t <= a.ts AND b.t = (SELECT max(c.t) FROM b c WHERE c.user_id = a.user_id AND c.t <= a.ts) GROUP BY 1")
def asof_join(spark, sf_dir):
    """As-of join by one sort: the last view of a user before each purchase, from a union instead of a range join."""
    e = view(spark, sf_dir, "events")
    both = e.filter("event_type IN ('view', 'purchase')").withColumn("seen", F.when(F.col("event_type") == "view", F.struct("ts", "event_id")))
    last = F.max("seen").over(W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn("last", last).filter("event_type = 'purchase'").select("event_id", F.col("last.event_id").alias("last_view"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_windows(spark, sf_dir):
    e = view(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "6 hours")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")
