"""Queries of usage, audit and insight logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.operators import usage as u
from lexlake.plans.registry import query, view
from lexlake.streaming import streams

NOW = "TIMESTAMP '2024-01-20 12:00:00'"


@query("SELECT currency, CAST(sum(cost_micros) AS BIGINT) AS cost_micros FROM {usage} WHERE tenant_id = 't1' AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20' AND status = 'SUCCEEDED' AND priced GROUP BY 1")
def cost_by_currency(spark, sf_dir):
    return u.cost_by_currency(view(spark, sf_dir, "usage"), "t1", F.expr("TIMESTAMP '2024-01-05'"), F.expr("TIMESTAMP '2024-01-20'"))


@query("SELECT tenant_id, count(*) FILTER (WHERE status = 'SUCCEEDED') AS calls, count(*) FILTER (WHERE status = 'SUCCEEDED' AND estimated) AS estimated_calls, count(*) FILTER (WHERE status = 'SUCCEEDED' AND NOT priced) AS unpriced_calls FROM {usage} GROUP BY 1")
def estimate_counts(spark, sf_dir):
    return u.estimate_counts(view(spark, sf_dir, "usage"), "tenant_id")


_MONTHLY = "SELECT tenant_id, CASE tenant_id WHEN 't0' THEN 0 ELSE 40000000 END AS quota_tokens, CAST(sum(total_tokens) AS BIGINT) AS used_tokens, count(*) * 10 AS reserved_tokens FROM {usage} GROUP BY 1"


@query(f"SELECT tenant_id, CASE WHEN quota_tokens > 0 THEN greatest(0, quota_tokens - used_tokens - reserved_tokens) END AS remaining, quota_tokens = 0 OR used_tokens + reserved_tokens + 500 <= quota_tokens AS allowed FROM ({_MONTHLY})")
def usage_summary(spark, sf_dir):
    monthly = spark.sql(_MONTHLY, usage=view(spark, sf_dir, "usage"))
    return u.quota_allows(u.usage_summary(monthly), F.lit(500)).select("tenant_id", "remaining", "allowed")


@query("SELECT id, CAST((CAST(total_tokens AS HUGEINT) * 1234567 + 999999) // 1000000 AS BIGINT) AS cost, CAST((CAST(total_tokens AS HUGEINT) * greatest(800, id % 2000) + 999999) // 1000000 AS BIGINT) AS charge FROM {usage}")
def token_costs(spark, sf_dir):
    return view(spark, sf_dir, "usage").select("id", u.token_cost(F.col("total_tokens"), F.lit(1234567)).alias("cost"), u.estimated_charge(F.col("total_tokens"), F.lit(800).cast("long"), F.expr("id % 2000")).alias("charge"))


@query("SELECT strftime(created_at + INTERVAL 8 HOUR, '%Y-%m') AS month, count(*) AS n FROM {usage} GROUP BY 1")
def usage_by_month(spark, sf_dir):
    return view(spark, sf_dir, "usage").groupBy(u.month_key(F.col("created_at")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE zero_hit) AS zero_hits, round(count(*) FILTER (WHERE zero_hit) / count(*), 6) AS zero_hit_rate, count(*) FILTER (WHERE trim(coalesce(degraded, '')) <> '') AS degraded FROM {insight}")
def insight_stats(spark, sf_dir):
    return u.insight_stats(view(spark, sf_dir, "insight"))


@query("SELECT query_hash, count(*) AS hits, arg_max(query_digest, id) AS query_digest, arg_max(created_at, id) AS last_at, min(id) AS first_id FROM {insight} WHERE zero_hit GROUP BY 1 ORDER BY hits DESC, first_id LIMIT 10")
def top_zero_hit_queries(spark, sf_dir):
    return u.top_zero_hit_queries(view(spark, sf_dir, "insight"))


@query("SELECT app_id, count(*) AS total, round(avg(coalesce(latency_ms, 0)), 6) AS avg_latency_ms, count(*) FILTER (WHERE trim(coalesce(degraded, '')) NOT IN ('', '[]')) AS degraded, count(*) FILTER (WHERE status_code >= 400) AS errors FROM {audit} GROUP BY 1")
def audit_stats(spark, sf_dir):
    return u.audit_stats(view(spark, sf_dir, "audit"), "app_id")


@query("SELECT task_type, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'RUNNING') AS running, count(*) FILTER (WHERE status = 'FAILED') AS failed FROM {task} GROUP BY 1")
def task_backlog(spark, sf_dir):
    return u.backlog(view(spark, sf_dir, "task"), ["PENDING", "RUNNING", "FAILED"])


@query("SELECT count(*) FILTER (WHERE status IN ('PENDING', 'FAILED')) AS waiting, count(*) FILTER (WHERE status IN ('PENDING', 'FAILED')) > 1000 AS raised FROM {task}")
def sync_backlog_alert(spark, sf_dir):
    return u.backlog_alert(view(spark, sf_dir, "task"), 1000)


@query("SELECT user_id, count(*) AS nodes, max(ts) AS last_at FROM events GROUP BY 1")
def entities_per_library(spark, sf_dir):
    return u.entities_per_library(view(spark, sf_dir, "events").withColumnRenamed("ts", "updated_at"))


@query("SELECT event_type AS rule_id, count(DISTINCT user_id) AS users, count(*) AS nodes FROM events GROUP BY 1")
def memory_rule_totals(spark, sf_dir):
    return u.library_totals(view(spark, sf_dir, "events").withColumnRenamed("event_type", "rule_id"))


@query("WITH s AS (SELECT *, sum(ok::INT) OVER (PARTITION BY task_type ORDER BY seq) AS g FROM {task}) SELECT task_type, seq, CAST(CASE WHEN ok THEN 0 ELSE sum((NOT ok)::INT) OVER (PARTITION BY task_type, g ORDER BY seq) END AS BIGINT) AS failures FROM s")
def consecutive_failures(spark, sf_dir):
    return u.consecutive_failures(view(spark, sf_dir, "task").select("task_type", "seq", "ok")).select("task_type", "seq", "failures")


@query("""WITH s AS (SELECT kb_id AS source, id, epoch(date_trunc('second', created_at))::BIGINT AS t, coalesce(degraded = 'RERANK_TIMEOUT', false) AS d FROM {insight}),
w AS (SELECT source, id, count(*) OVER o AS n, sum(d::INT) OVER o AS bad FROM s WINDOW o AS (PARTITION BY source ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))
SELECT source, id, CASE WHEN n >= 20 THEN round(bad / n, 6) END AS rate FROM w""")
def degrade_rate(spark, sf_dir):
    rows = view(spark, sf_dir, "insight").select(F.col("kb_id").alias("source"), "id", F.col("created_at").alias("ts"), F.coalesce(F.col("degraded") == "RERANK_TIMEOUT", F.lit(False)).alias("degraded"))
    return u.degrade_rate(rows, 86400).select("source", "id", "rate")


@query("""WITH s AS (SELECT kb_id AS source, created_at AS ts, coalesce(degraded = 'RERANK_TIMEOUT', false) AS d FROM {insight}),
w AS (SELECT source, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, d FROM s)
SELECT source, start, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(sum(d::INT) / count(*), 6) END AS rate FROM w GROUP BY 1, 2""")
def degrade_windows(spark, sf_dir):
    rows = view(spark, sf_dir, "insight").select(F.col("kb_id").alias("source"), F.col("created_at").cast("timestamp").alias("ts"), F.coalesce(F.col("degraded") == "RERANK_TIMEOUT", F.lit(False)).alias("degraded"))
    return streams.degrade_windows(rows, "6 hours", "6 hours").select("source", F.col("start").cast("timestamp_ntz").alias("start"), "n", "rate")


@query("SELECT id FROM {insight} WHERE created_at < TIMESTAMP '2024-01-10'")
def retention_purge(spark, sf_dir):
    return u.expired(view(spark, sf_dir, "insight"), "created_at", F.expr(NOW), 10)[1].select("id")


@query("SELECT id, status FROM {task} WHERE retry < 5 AND (status = 'FAILED' OR (status = 'PENDING' AND updated_at < TIMESTAMP '2024-01-20 11:55:00')) ORDER BY id LIMIT 500")
def compensation_scan(spark, sf_dir):
    return u.due_for_retry(view(spark, sf_dir, "task"), F.expr(NOW)).select("id", "status")


@query("SELECT id FROM {task} WHERE status IN ('PENDING', 'RUNNING') AND updated_at < TIMESTAMP '2024-01-20 10:00:00'")
def stuck_runs(spark, sf_dir):
    return u.stuck(view(spark, sf_dir, "task"), F.expr(NOW)).select("id")


@query("SELECT id, app_id FROM {audit} ORDER BY id DESC LIMIT 20 OFFSET 40")
def audit_page(spark, sf_dir):
    return u.page(view(spark, sf_dir, "audit").select("id", "app_id"), 3, 20)


@query("""WITH l AS (SELECT user_id, ts, event_id % 6 = 0 AS ok, event_id % 5 = 0 AS dir FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'),
s AS (SELECT user_id, max(ts) FILTER (WHERE ok) AS last_ok FROM l GROUP BY 1) SELECT l.user_id, count(*) AS failures FROM l JOIN s USING (user_id) WHERE NOT ok AND NOT dir AND (last_ok IS NULL OR ts > last_ok) GROUP BY 1 HAVING count(*) >= 5""")
def locked_out_users(spark, sf_dir):
    logins = view(spark, sf_dir, "events").select("user_id", F.col("ts").alias("at"), (F.expr("event_id % 6 = 0")).alias("ok"), F.when(F.expr("event_id % 5 = 0"), "DIRECTORY_UNAVAILABLE").alias("reason"))
    return u.locked_out(logins, F.expr(NOW), minutes=5 * 24 * 60)


@query()
def token_bucket(spark, sf_dir):
    return streams.rate_limit(view(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts")), 1).select("key", "event_id", "allowed")


@query("""WITH s AS (SELECT user_id AS call_id, ts, CASE WHEN event_id % 2 = 0 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, event_id AS tokens FROM events WHERE event_id % 3 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY ts, status) AS k FROM s) SELECT call_id, ts, status FROM r WHERE k = 1""")
def usage_ledger(spark, sf_dir):
    calls = view(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), "ts", F.expr("CASE WHEN event_id % 3 = 0 THEN 'RESERVED' WHEN event_id % 2 = 0 THEN 'SUCCEEDED' ELSE 'FAILED' END").alias("status"), F.col("event_id").alias("tokens"))
    return streams.usage_ledger(calls).select("call_id", "ts", "status")
