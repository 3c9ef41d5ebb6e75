"""Queries of text, web page and chat operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.operators import chat, split
from lexlake.operators import text as t
from lexlake.plans.registry import query, view
from lexlake.sources import files


def _docs(spark, sf_dir):
    return view(spark, sf_dir, "documents")


_MIXED = "SELECT doc_id, concat(text, CASE doc_id % 6 WHEN 0 THEN '한글 값' WHEN 1 THEN '日本語、カナ' WHEN 2 THEN '⺀⻿豈' WHEN 3 THEN 'Ａ１！' WHEN 4 THEN '😀😀😀' ELSE '㐀中' END) AS text FROM {documents}"


@query(rf"""WITH m AS ({_MIXED}), c AS (SELECT doc_id, text, length(regexp_replace(text, '[^\x{{3000}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]', '', 'g')) AS cjk,
length(regexp_replace(text, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS far FROM m) SELECT doc_id, CAST(cjk + ceil((length(text) + far - cjk) / 4) AS BIGINT) AS tokens FROM c""")
def token_estimate(spark, sf_dir):
    return spark.sql(_MIXED, documents=_docs(spark, sf_dir)).select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\d', '', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def normal_line(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.normal_line(F.col("text"))).alias("h"))


_PAGES = "SELECT source AS doc_id, doc_id AS page_no, concat('Header of ', source, ' ', CAST(doc_id AS STRING), chr(10), text, chr(10), 'Page ', CAST(doc_id AS STRING)) AS text FROM {documents}"


@query(f"""WITH p AS ({_PAGES}), l AS (SELECT doc_id, page_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM p),
e AS (SELECT doc_id, page_no, unnest(list_distinct(list_concat(l[1:2], l[-2:]))) AS raw FROM l),
n AS (SELECT DISTINCT doc_id, page_no, trim(regexp_replace(regexp_replace(raw, '\\d', '', 'g'), '\\s+', ' ', 'g')) AS line FROM e WHERE length(raw) <= 120),
c AS (SELECT doc_id, line, count(DISTINCT page_no) AS n FROM n WHERE line <> '' GROUP BY 1, 2), q AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM p GROUP BY 1)
SELECT doc_id, line FROM c JOIN q USING (doc_id) WHERE pages >= 2 AND n >= greatest(2, ceil(0.6 * pages))""")
def page_furniture(spark, sf_dir):
    return t.page_furniture(spark.sql(_PAGES, documents=_docs(spark, sf_dir)))


@query(f"WITH p AS ({_PAGES}) SELECT doc_id, page_no, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^(Header of src\\d+ \\d+|Page \\d+)$')), chr(10))) AS h FROM p")
def furniture_removed(spark, sf_dir):
    return t.remove_furniture(spark.sql(_PAGES, documents=_docs(spark, sf_dir))).select("doc_id", "page_no", F.md5("text").alias("h"))


_NAMES = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(rf"""WITH p AS (SELECT doc_id, text, regexp_split_to_array(text, '{_NAMES}') AS rest, regexp_extract_all(text, '{_NAMES}') AS found FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(rest, lambda x, i: concat(x, CASE WHEN i <= len(found) THEN concat(CASE WHEN strpos(found[i], '@') > 2 THEN left(found[i], 1) ELSE '' END, repeat('*', greatest(strpos(found[i], '@') - 2, 1)), substr(found[i], strpos(found[i], '@'))) END)), '')) AS h FROM p""")
def mask_email(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.mask_email(F.col("text"))).alias("h"))


@query()
def mask_sensitive(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.mask_sensitive(F.col("text")).alias("text"))


@query(r"SELECT doc_id, md5(replace(regexp_replace(text, '(?i)all rights reserved\.?', '', 'g'), 'the', '$1')) AS h FROM documents")
def clean_rules(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(t.clean(F.col("text"), [r"(?i)all rights reserved\.?"], [("the", "$1")], mask=False)).alias("h"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '\s+', '', 'g')) AS h FROM documents")
def text_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.text_hash(F.col("text"), compatible=False).alias("h"))


@query()
def text_hash_nfkc(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.text_hash(F.col("text")).alias("h"))


@query(r"SELECT item_id, sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) AS h FROM benchmark")
def query_hash(spark, sf_dir):
    return view(spark, sf_dir, "benchmark").select("item_id", t.query_hash(F.col("text")).alias("h"))


@query(r"""WITH s AS (SELECT item_id AS id, regexp_replace(text, '\s+', '', 'g') AS b FROM benchmark WHERE length(text) >= 10),
d AS (SELECT doc_id AS id, regexp_replace(text, '\s+', '', 'g') AS b FROM documents),
sg AS (SELECT id, list_distinct(list_transform(range(1, greatest(length(b) - 1, 1)), lambda i: b[i:i+2])) AS g FROM s), dg AS (SELECT id, list_distinct(list_transform(range(1, greatest(length(b) - 1, 1)), lambda i: b[i:i+2])) AS g FROM d),
p AS (SELECT s.id AS source_id, d.id AS target_id, round(2.0 * len(list_intersect(s.g, d.g)) / (len(s.g) + len(d.g)), 9) AS score FROM sg s, dg d),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM p WHERE score >= 0.35) SELECT source_id, target_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def fuzzy_matches(spark, sf_dir):
    source = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return t.fuzzy_matches(source, _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))


@query(r"SELECT doc_id, nullif(left(regexp_extract(text, '([\w.]+)@', 1), 256), '') AS name, array_to_string(list_filter(['the', 'ung', 'tion', 'zz'], lambda w: contains(text, w)), ',') AS words FROM documents")
def metadata_rules(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.metadata_regex(F.col("text"), r"([\w.]+)@").alias("name"), F.array_join(t.metadata_keywords(F.col("text"), ["the", "ung", "tion", "zz"]), ",").alias("words"))


@query()
def graph_terms(spark, sf_dir):
    return view(spark, sf_dir, "benchmark").select("item_id", F.array_join(t.graph_terms(F.col("text")), " ").alias("terms"))


@query(r"SELECT page_id, regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '//(localhost|127\.|10\.)') AS allowed, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([^./]+)$', 1)) AS ext FROM pages")
def url_guard(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", t.url_allowed(F.col("url")).alias("allowed"), t.extension(F.regexp_replace("url", "[?#].*$", "")).alias("ext"))


_LOGINS = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://a.example/SSO/x' WHEN 1 THEN 'https://login.example/' WHEN 2 THEN 'https://a.example/author/1' WHEN 3 THEN 'https://a.example/cas?x' WHEN 4 THEN 'https://a.example/authorize' WHEN 5 THEN url ELSE 'https://a.example/x-login' END AS url,
    concat(CASE page_id % 5 WHEN 0 THEN '<TITLE>Sign in</title>' WHEN 1 THEN '<title lang=x>登录</title>' WHEN 2 THEN '<title>About</title> log in' WHEN 3 THEN '<title>Log  in</title>' ELSE '<title>Please login</title>' END,
    CASE WHEN page_id % 7 = 0 THEN '<INPUT name=p type = \"password\">' WHEN page_id % 7 = 1 THEN '<input type=text>password' ELSE '' END, html) AS html FROM {pages}"""


@query(rf"""WITH p AS ({_LOGINS.replace(chr(92), "")}) SELECT page_id, regexp_matches(html, '(?i)<input[^>]{{0,300}}type\s*=\s*[\x22\x27]?password') OR
(regexp_matches(lower(url), '(^|[/.])(login|signin|sign-in|sso|cas|authorize)([/.?#]|$)') AND regexp_matches(html, '(?i)<title[^>]*>[^<]*(log\s?in|sign\s?in|登录|登入)')) AS wall FROM p""")
def login_walls(spark, sf_dir):
    return spark.sql(_LOGINS.replace(chr(92), ""), pages=view(spark, sf_dir, "pages")).select("page_id", t.login_wall(F.col("url"), F.col("html")).alias("wall"))


_KEYS = "SELECT page_id, concat(url, CASE page_id % 6 WHEN 0 THEN '/.hidden' WHEN 1 THEN '/Ünder Score_报告.v2.PDF' WHEN 2 THEN '/---' WHEN 3 THEN concat('/', repeat('Long ', 60), '.md') WHEN 4 THEN '' ELSE '/a.b/c' END) AS k FROM {pages}"


@query(f"""WITH k AS (SELECT page_id, k, regexp_extract(k, '([^/]*)$', 1) AS name FROM ({_KEYS})), b AS (SELECT page_id, k, CASE WHEN position('.' IN substr(name, 2)) > 0 THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS base FROM k)
SELECT page_id, concat(left(trim(regexp_replace(lower(base), '[^a-z0-9\u4e00-\u9fa5]+', '-', 'g'), '-'), 187), '-', left(sha256(k), 8), '.pdf') AS name FROM b""")
def url_slugs(spark, sf_dir):
    return spark.sql(_KEYS, pages=view(spark, sf_dir, "pages")).select("page_id", t.slug(F.col("k"), F.lit("pdf")).alias("name"))


@query("SELECT doc_id, sha256(concat_ws('|', lang, source, CAST(n_chars AS STRING), '')) AS fp, concat('kb_', lower(lang), '_m-1_64_s', CAST(doc_id % 5 AS STRING)) AS name, doc_id % 5 AS snapshot FROM documents")
def version_fingerprints(spark, sf_dir):
    name = F.concat(t.index_name("kb", F.col("lang"), F.lit("M 1"), F.lit(64)), F.lit("_s"), F.expr("doc_id % 5"))
    return _docs(spark, sf_dir).select("doc_id", t.fingerprint(F.col("lang"), F.col("source"), F.col("n_chars"), F.lit(None)).alias("fp"), name.alias("name"), t.snapshot_number(name).alias("snapshot"))


@query("""WITH k AS (SELECT conv_id AS doc_id, turn AS page_no, text, length(text) AS n FROM conversations WHERE trim(text) <> ''),
r AS (SELECT *, CAST(coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM k)
SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_no)) AS h, string_agg(concat(page_no, ':', s, '-', s + n), ',' ORDER BY page_no) AS ranges FROM r GROUP BY 1""")
def assemble_pages(spark, sf_dir):
    out = t.assemble_pages(view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"))
    line = F.array_join(F.transform("ranges", lambda r: F.concat(r["page_no"], F.lit(":"), r["start"], F.lit("-"), r["stop"])), ",")
    return out.select("doc_id", F.md5("text").alias("h"), line.alias("ranges"))


@query("SELECT conv_id AS session_id, md5(string_agg(concat('[', strftime(make_timestamp(turn * 60000000), '%Y-%m-%d %H:%M:%S'), '] ', role, ': ', text), chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def render_sessions(spark, sf_dir):
    return chat.render(chat.conversation_messages(view(spark, sf_dir, "conversations"))).select("session_id", F.md5("text").alias("h"))


@query("SELECT conv_id AS session_id, count(*) AS messages, min(turn) * 60000 AS first_time, max(turn) * 60000 AS last_time FROM conversations GROUP BY 1")
def session_stats(spark, sf_dir):
    return chat.session_stats(chat.conversation_messages(view(spark, sf_dir, "conversations")))


@query("""WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn * 60000 AS t, role FROM conversations)
SELECT conv_id AS session_id, i // 3 AS seq, min(i) AS first_msg, max(i) AS last_msg, min(t) AS start_time, max(t) AS end_time FROM m GROUP BY 1, 2""")
def chat_windows(spark, sf_dir):
    return chat.chat_windows(chat.conversation_messages(view(spark, sf_dir, "conversations")), minutes=600, most=3).drop("senders")


@query()
def chat_windows_overlap(spark, sf_dir):
    return chat.chat_windows(chat.conversation_messages(view(spark, sf_dir, "conversations")), minutes=4, most=5, overlap=1)


@query()
def merge_near_windows(spark, sf_dir):
    windows = chat.chat_windows(chat.conversation_messages(view(spark, sf_dir, "conversations")), most=5, overlap=2)
    ranked = windows.select(F.lit(0).alias("query_id"), F.col("seq").alias("position"), F.concat_ws("-", F.col("session_id").cast("string"), F.col("seq").cast("string")).alias("chunk_id"), "session_id", "first_msg", "last_msg")
    return chat.merge_near_windows(ranked, 0.4)


@query("SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'NEW_VERSION' ELSE 'CREATE' END AS action FROM conversations")
def match_sessions(spark, sf_dir):
    sessions = view(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    return chat.match_sessions(sessions, sessions.filter("session_id % 3 = 0").select(F.col("session_id").alias("source_key"), F.col("session_id").alias("doc_id"))).select("session_id", "action")


@query()
def html_markdown(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", files.markdown_of("html").alias("markdown"))


@query()
def split_fixed(spark, sf_dir):
    return split.split_documents(_docs(spark, sf_dir), "fixed", 200, overlap=40)


@query()
def split_separator(spark, sf_dir):
    return split.split_documents(_docs(spark, sf_dir), "separator", 200, separator="\n")


@query()
def split_heading(spark, sf_dir):
    pages = view(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), files.markdown_of("html").alias("text"))
    return split.split_documents(pages, "heading", 200)


@query()
def split_parent_child(spark, sf_dir):
    return split.split_parent_child(_docs(spark, sf_dir), 400, 100, 20)


@query("SELECT event_id, k IN (1, 3, 5) AS t FROM (SELECT event_id, event_id % 7 AS k FROM events)")
def truthy_words(spark, sf_dir):
    words = F.array(*map(F.lit, ["no", "1", "x", "TRUE", "0", " yes ", ""]))
    return view(spark, sf_dir, "events").select("event_id", t.truthy(F.get(words, F.expr("event_id % 7"))).alias("t"))


@query("SELECT event_id, epoch_ms(date_trunc('second', ts)) AS a, CAST(CASE WHEN event_id >= 0 THEN (1700000000 + event_id) * 1000 END AS BIGINT) AS b FROM events")
def parse_times(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    return e.select("event_id", t.parse_time_ms(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("a"), t.parse_time_ms((F.col("event_id") + 1700000000).cast("string")).alias("b"))


_KINDS = [("Voice", "voice"), ("43", "video"), ("picture", "image"), ("", "text"), ("1", "text"), ("sticker", "other"), ("62.0", "video"), ("context", "other"), ("语音消息", "voice"), ("my photo!", "image"), ("photos", "other"), ("照片", "image"), ("文字", "text"), ("34", "voice"), ("text video", "video"), ("3", "image"), ("99", "other")]


@query(f"SELECT event_id, {[kind for _, kind in _KINDS]}[CAST(event_id % {len(_KINDS)} AS INT) + 1] AS kind FROM events")
def message_types(spark, sf_dir):
    words = F.array(*(F.lit(word) for word, _ in _KINDS))
    return view(spark, sf_dir, "events").select("event_id", t.message_type(F.get(words, F.expr(f"event_id % {len(_KINDS)}"))).alias("kind"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_answers(spark, sf_dir):
    fenced = F.concat(F.lit("```json\nanswer: "), "props", F.lit("\n```"))
    return view(spark, sf_dir, "events").select("event_id", F.from_json(t.json_object(t.strip_fences(fenced)), "k bigint")["k"].alias("k"))
