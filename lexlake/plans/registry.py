"""Registration of queries with their DuckDB twins, and views of the test tables as the engine's own records.

A view's text is valid in Spark SQL and DuckDB alike; ``{table}`` stands for an input table or another view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.storage import spread, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "usage": """SELECT event_id AS id, concat('t', CAST(user_id % 5 AS STRING)) AS tenant_id, CASE WHEN value > 20 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
        CAST(floor(value * 1000) AS BIGINT) AS total_tokens, event_id % 7 = 0 AS estimated, event_id % 5 <> 0 AS priced,
        CASE WHEN user_id % 2 = 0 THEN 'CNY' ELSE 'USD' END AS currency, CAST(floor(value * 10000) AS BIGINT) AS cost_micros, ts AS created_at FROM {events}""",
    "insight": """SELECT event_id AS id, concat('kb', CAST(user_id % 3 AS STRING)) AS kb_id, concat('q', CAST(user_id % 40 AS STRING)) AS query_hash,
        concat(event_type, '-', CAST(user_id % 40 AS STRING)) AS query_digest, event_id % 6 = 0 AS zero_hit, CASE WHEN event_id % 9 = 0 THEN 'RERANK_TIMEOUT' WHEN event_id % 4 = 0 THEN ' ' END AS degraded,
        ts AS created_at FROM {events}""",
    "audit": """SELECT event_id AS id, concat('app', CAST(user_id % 4 AS STRING)) AS app_id, CASE WHEN event_id % 11 <> 0 THEN CAST(floor(value) AS BIGINT) END AS latency_ms,
        CASE WHEN event_id % 8 = 0 THEN '[]' WHEN event_id % 13 = 0 THEN '["X"]' END AS degraded, CASE WHEN event_id % 17 = 0 THEN 500 ELSE 200 END AS status_code, ts AS created_at FROM {events}""",
    "task": """SELECT event_id AS id, event_type AS task_type, CASE WHEN event_id % 5 = 0 THEN 'FAILED' WHEN event_id % 3 = 0 THEN 'PENDING' WHEN event_id % 2 = 0 THEN 'RUNNING' ELSE 'DONE' END AS status,
        event_id % 7 AS retry, event_id % 5 <> 0 AS ok, event_id AS seq, ts AS updated_at FROM {events}""",
    "document": """SELECT doc_id, concat('kb', CAST(doc_id % 3 AS STRING)) AS kb_id, text, source, lang, CASE WHEN doc_id % 10 <> 0 THEN concat('v', CAST(doc_id AS STRING)) END AS current_version,
        doc_id % 17 = 0 AS trashed, CASE WHEN doc_id % 7 = 0 THEN 'DRAFT' ELSE 'PUBLISHED' END AS publish_status, CASE WHEN doc_id % 4 = 0 THEN 'RESTRICTED' ELSE 'PUBLIC' END AS visibility,
        CASE WHEN doc_id % 5 = 0 THEN doc_id % 100 END AS effective_at, CASE WHEN doc_id % 6 = 0 THEN doc_id % 90 END AS expires_at, md5(text) AS content_hash FROM {documents}""",
    "chunk": """SELECT concat('c', CAST(doc_id AS STRING)) AS chunk_id, concat('kb', CAST(doc_id % 3 AS STRING)) AS kb_id, doc_id, concat('v', CAST(doc_id AS STRING)) AS document_version_id,
        CASE WHEN doc_id % 3 <> 0 THEN concat('p', CAST(doc_id % 50 AS STRING)) END AS parent_id, doc_id % 11 <> 0 AS enabled, source AS sender, doc_id * 1000 AS msg_time, text AS content, n_chars FROM {documents}""",
    "route": """SELECT o_custkey % 20 AS query_id, CASE o_orderkey % 4 WHEN 0 THEN 'VECTOR' WHEN 1 THEN 'BM25' WHEN 2 THEN 'MULTIMODAL' ELSE 'GRAPH' END AS route,
        concat('c', CAST(o_orderkey % 60 AS STRING)) AS chunk_id, max(round(o_totalprice / 1000, 3)) AS score FROM {orders} GROUP BY 1, 2, 3""",
    "ranked": """SELECT o_custkey % 20 AS query_id, concat('kb', CAST(o_orderkey % 3 AS STRING)) AS kb_id, concat('c', CAST(o_orderkey AS STRING)) AS chunk_id, round(o_totalprice / 1000, 3) AS fused_score FROM {orders}""",
    "candidate": """SELECT CAST(floor(o_custkey / 8) AS BIGINT) AS query_id, concat('c', CAST(o_orderkey AS STRING)) AS chunk_id, CASE WHEN o_orderkey % 3 <> 0 THEN concat('p', CAST(o_orderkey % 25 AS STRING)) END AS parent_id,
        CAST(floor(o_totalprice / 10) AS DOUBLE) / CAST(10000 AS DOUBLE) AS rerank_score, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice / 777, 6) END AS bm25_score,
        CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 100) / 100.0 END AS vector_score, round(o_totalprice / 1000000, 6) AS fused_score, o_orderkey % 300 AS content_length FROM {orders}""",
    "version": """SELECT o_orderkey AS id, o_custkey AS doc_id, concat('v', CAST(o_orderkey AS STRING)) AS version_id, CASE o_orderstatus WHEN 'O' THEN 'READY' WHEN 'F' THEN 'READY' ELSE 'FAILED' END AS status,
        o_orderkey % 9 = 0 AS active, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS created_at, CAST(o_orderkey % 4 + 1 AS INT) AS major, CAST(o_orderkey % 3 AS INT) AS minor,
        concat('h', CAST(o_orderkey % 6 AS STRING)) AS content_hash, concat('p', CAST(o_orderkey % 2 AS STRING)) AS parse_fp, concat('s', CAST(o_orderkey % 2 AS STRING)) AS chunk_fp, 'e1' AS embedding_version,
        CASE WHEN o_orderkey % 5 <> 0 THEN 'obj' END AS parsed_object FROM {orders}""",
    "edge": """SELECT l_orderkey AS src, l_orderkey + l_partkey % 50 + 1 AS dst, l_returnflag AS type FROM {lineitem}""",
    "mention": """SELECT DISTINCT l_orderkey AS entity, concat('c', CAST(l_partkey AS STRING)) AS chunk_id FROM {lineitem}""",
    "trace": """SELECT l_suppkey % 10 AS query_id, concat('c', CAST(l_orderkey % 300 AS STRING)) AS chunk_id, concat('e', CAST(l_partkey % 30 AS STRING)) AS entity_name,
        round(l_quantity / 50, 4) AS match_score, l_linenumber % 3 AS hops FROM {lineitem}""",
    "case": """SELECT concat('case', CAST(o_orderkey AS STRING)) AS case_id, o_orderkey AS seq, o_orderkey % 4 <> 0 AS hit, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 + 1 END AS hit_rank, o_orderkey % 3 AS evidence_hits,
        o_orderkey % 3 + 1 AS evidence_total, o_orderkey % 29 = 0 AS degraded, CASE WHEN o_orderkey % 2 = 0 THEN 'SPAN' ELSE 'DOCUMENT' END AS anchor_type, o_orderkey % 3 + 1 AS turns,
        CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 5 + 1 END AS score, o_orderkey % 5 AS correctness, o_orderkey % 4 AS faithfulness, o_orderkey % 3 AS completeness,
        o_orderkey % 7 <> 0 AS refusal_correct, CAST(floor(o_totalprice) AS BIGINT) AS latency_ms, o_orderkey % 11 <> 0 AS requested FROM {orders}""",
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _rounded(sql: str) -> str:
    """A view's text for Spark: its roundings as DuckDB does them, by the product with a power of ten. Spark's own goes by a number's decimal digits, and differs in halves."""
    return re.sub(r"\bround\(([^()]+), (\d+)\)", r"(round((\1) * 1e\2D, 0) / 1e\2D)", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or an input table."""
    if name not in VIEWS:
        rows = table(spark, sf_dir, name)
        return spread(rows) if name in ("documents", "pages") else rows
    needed = {n: view(spark, sf_dir, n) for n in re.findall(r"\{([a-z]{3,})\}", VIEWS[name])}
    return spark.sql(_rounded(VIEWS[name]), **needed)


def expand(sql: str) -> str:
    """DuckDB text of a query that names views in braces: each becomes a subquery, a table its name."""
    return re.sub(r"\{([a-z]{3,})\}", lambda m: m[1] if m[1] in TABLES else f"({expand(VIEWS[m[1]])})", sql)


def round_half(x: F.Column, digits: int) -> F.Column:
    """x rounded as DuckDB does: its product with a power of ten, halves away from zero. What is too large for that stays."""
    power = float(10**digits)
    return F.when(F.abs(x) < 1e300, F.round(x * power, 0) / power).otherwise(x)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Columns as the DuckDB twin has them: whole numbers long, fractions rounded."""
    kinds = {"int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long"), "double": lambda c: round_half(c, digits)}
    return df.select(*(kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, and its DuckDB twin."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = expand(sql)
        return f

    return add
