"""DuckDB SQL of the queries that SQL can express, over whole tables."""

#: Per-document counts and the host verdict with its beta prior.
QUALITY = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
win AS (SELECT doc_id, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) >= 2 AS t FROM win WHERE c IS NOT NULL),
marked AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, (VALUES (0), (1), (2)) v(k) WHERE t),
repeats AS (SELECT doc_id, count(*) AS n FROM marked GROUP BY doc_id),
per AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
j AS (SELECT d.doc_id, d.source, coalesce(per.n_words, 0)::BIGINT AS n_words, coalesce(per.word_chars, 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN per USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY source),
t AS (SELECT sum(n) AS docs, count(*)::DOUBLE AS hosts, sum(f) / sum(n) AS m, sum(f * f / n) AS s2 FROM h),
p AS (SELECT m, 100.0 * docs / hosts AS most, greatest(s2 / docs - m * m - m * (1 - m) * hosts / docs, 0.0) AS v FROM t),
q AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), most) ELSE most END AS strength FROM p),
bad AS (SELECT source, (f + strength * m) / (n + strength) > 0.5 AS bad FROM h, q)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad.bad AS kept
FROM b JOIN bad ON b.source IS NOT DISTINCT FROM bad.source
"""

#: Payload digests and revisits.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""

#: Words' buckets by CRC-32, counts, gains, weights, noise and ranks.
RESAMPLING = r"""
WITH RECURSIVE bits(k, b, v) AS (SELECT 0, b, b FROM range(256) r(b)
  UNION ALL SELECT k + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
target AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM lowered) GROUP BY ALL),
tw AS MATERIALIZED (SELECT word, count(*) AS c FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM target) GROUP BY ALL),
words AS (SELECT word FROM dw UNION SELECT word FROM tw),
hexed AS (SELECT word, hex(encode(word)) AS h FROM words),
hashed AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i::INT, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM hexed, crc),
s AS (SELECT bucket, sum(c)::DOUBLE AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(c)::DOUBLE AS t FROM tw JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000) / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain
  FROM range(10000) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
per AS (SELECT doc_id, sum(c)::BIGINT AS n, sum(c * gain)::BIGINT AS g FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN floor(g::DOUBLE / n)::BIGINT ELSE 0 END AS weight FROM documents d LEFT JOIN per USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM ranked) * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

_VALID = """e AS MATERIALIZED (SELECT vec_id, {more}list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true))"""

#: Every query's 20 best by brute force.
TOP_K = f"""
WITH {_VALID.format(scale=64, more="")},
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY rank <= 20
"""

#: Positives and negatives by brute force.
NEGATIVES = f"""
WITH {_VALID.format(scale=256, more="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, ")},
p AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND a.label IS NOT NULL AND c.label IS NOT NULL),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
