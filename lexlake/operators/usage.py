"""Aggregations over usage, audit and search-insight logs, and their retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MONTH_ZONE = "Asia/Shanghai"


def month_key(ts: Column, zone: str = MONTH_ZONE) -> Column:
    """yyyy-MM of a UTC time in the zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM")


def cost_by_currency(usage: DataFrame, tenant: str, start: Column, end: Column) -> DataFrame:
    """Cost of a tenant's successful priced calls in [start, end), by currency."""
    kept = usage.filter((F.col("tenant_id") == tenant) & (F.col("created_at") >= start) & (F.col("created_at") < end) & (F.col("status") == "SUCCEEDED") & F.col("priced"))
    return kept.groupBy("currency").agg(F.sum("cost_micros").alias("cost_micros")).orderBy("currency")


def estimate_counts(usage: DataFrame, *by: str) -> DataFrame:
    """Successful calls, and those with estimated tokens or without a price."""
    ok = F.col("status") == "SUCCEEDED"
    return usage.groupBy(*by).agg(F.count_if(ok).alias("calls"), F.count_if(ok & F.col("estimated")).alias("estimated_calls"), F.count_if(ok & ~F.col("priced")).alias("unpriced_calls"))


def usage_summary(monthly: DataFrame) -> DataFrame:
    """remaining = max(0, quota - used - reserved); null for a quota of 0, which is none."""
    left = F.greatest(F.lit(0), F.col("quota_tokens") - F.col("used_tokens") - F.col("reserved_tokens"))
    return monthly.withColumn("remaining", F.when(F.col("quota_tokens") > 0, left))


def quota_allows(monthly: DataFrame, request: Column) -> DataFrame:
    """allowed: whether a reservation of so many tokens fits the tenant's quota (0: no limit)."""
    fits = F.col("used_tokens") + F.col("reserved_tokens") + request <= F.col("quota_tokens")
    return monthly.withColumn("allowed", (F.col("quota_tokens") == 0) | fits)


def token_cost(tokens: Column, micros_per_million: Column) -> Column:
    """Price of tokens, rounded up to a micro-unit, in exact integers."""
    exact = tokens.cast("decimal(20,0)") * micros_per_million.cast("decimal(18,0)")
    return F.ceil(exact / F.lit(1_000_000).cast("decimal(7,0)")).cast("long")


def estimated_charge(reserved: Column, price_in: Column, price_out: Column) -> Column:
    return token_cost(reserved, F.greatest(price_in, price_out))


def insight_stats(insights: DataFrame) -> DataFrame:
    """One row: total, zero_hits, zero_hit_rate, degraded (rows with a marker that isn't blank)."""
    total, zero = F.count(F.lit(1)), F.count_if(F.col("zero_hit"))
    rate = F.when(total > 0, zero / total).otherwise(0.0)
    return insights.agg(total.alias("total"), zero.alias("zero_hits"), rate.alias("zero_hit_rate"), F.count_if(F.trim(F.coalesce("degraded", F.lit(""))) != "").alias("degraded"))


def top_zero_hit_queries(insights: DataFrame, n: int = 10) -> DataFrame:
    """Queries without hits, the commonest first (equal ones by first occurrence), with digest and time of the last row."""
    kept = insights.filter("zero_hit AND query_hash IS NOT NULL")
    grouped = kept.groupBy("query_hash").agg(F.count(F.lit(1)).alias("hits"), F.max_by("query_digest", "id").alias("query_digest"), F.max_by("created_at", "id").alias("last_at"), F.min("id").alias("first_id"))
    return grouped.orderBy(F.col("hits").desc(), "first_id").limit(n)


def audit_stats(audits: DataFrame, *by: str) -> DataFrame:
    """total, mean latency (a missing one counts 0), degraded (neither blank nor []), errors (status 400 and up)."""
    marks = F.trim(F.coalesce("degraded", F.lit("")))
    return audits.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.avg(F.coalesce("latency_ms", F.lit(0))).alias("avg_latency_ms"), F.count_if((marks != "") & (marks != "[]")).alias("degraded"), F.count_if(F.col("status_code") >= 400).alias("errors"))


def backlog(tasks: DataFrame, statuses: list[str]) -> DataFrame:
    """Tasks by type, a column for each status."""
    return tasks.groupBy("task_type").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses))


def backlog_alert(tasks: DataFrame, limit: int) -> DataFrame:
    """waiting: rows PENDING or FAILED; raised if more than limit."""
    return tasks.agg(F.count_if(F.col("status").isin("PENDING", "FAILED")).alias("waiting")).withColumn("raised", F.col("waiting") > limit)


def entities_per_library(nodes: DataFrame) -> DataFrame:
    """Users of a memory library: nodes and last change, the latest first."""
    return nodes.groupBy("user_id").agg(F.count(F.lit(1)).alias("nodes"), F.max("updated_at").alias("last_at")).orderBy(F.col("last_at").desc(), "user_id")


def library_totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("rule_id").agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("nodes"))


def consecutive_failures(runs: DataFrame) -> DataFrame:
    """runs (task_type, seq, ok) with the length of the run of failures that each row ends (0 for a success)."""
    order = W.partitionBy("task_type").orderBy("seq")
    island = runs.withColumn("__s", F.sum(F.col("ok").cast("int")).over(order))
    failed = F.sum((~F.col("ok")).cast("int")).over(W.partitionBy("task_type", "__s").orderBy("seq"))
    return island.withColumn("failures", F.when(F.col("ok"), 0).otherwise(failed)).drop("__s")


def degrade_rate(samples: DataFrame, seconds: int = 300, least: int = 20) -> DataFrame:
    """samples (source, ts, degraded) with the rate over the last seconds; null for fewer than least samples.

    Samples are counted by second, and a count is taken off again when its time is over: running sums, however much lies in a
    window. Time is cut into spans as long as a window; the sums of a span begin with the counts of the one before.
    """
    length = seconds + 1
    rows = samples.withColumn("__at", F.col("ts").cast("timestamp").cast("long"))
    counts = {"n": F.count(F.lit(1)), "bad": F.coalesce(F.sum(F.col("degraded").cast("int")), F.lit(0)), "known": F.count("degraded")}
    each = rows.groupBy("source", "__at").agg(*(v.alias(k) for k, v in counts.items())).withColumn("slot", F.floor(F.col("__at") / length))
    change = lambda later, at, sign, own: F.struct((F.col("slot") + later).alias("slot"), at.alias("at"), F.lit(sign).alias("sign"), F.lit(own).alias("own"))
    at = F.col("__at")
    changes = F.when(at.isNull(), F.array(change(0, at, 1, True))).otherwise(F.array(change(0, at, 1, True), change(1, at, 1, False), change(1, at + length, -1, False)))
    dealt = each.select("source", *counts, F.explode(changes).alias("c")).select("source", "c.*", *((F.col(k) * F.col("c.sign")).alias(k) for k in counts))
    so_far = W.partitionBy("source", "slot").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    held = dealt.select("source", "at", "own", *(F.sum(k).over(so_far).alias(k) for k in counts)).filter("own")
    last = held.select(F.col("source").alias("__source"), F.col("at").alias("__second"), "n", F.when(F.col("known") > 0, F.col("bad")).alias("bad"))
    out = rows.join(last, F.col("source").eqNullSafe(F.col("__source")) & at.eqNullSafe(F.col("__second")))
    return out.withColumn("rate", F.when(F.col("n") >= least, F.col("bad") / F.col("n"))).drop("__at", "__source", "__second")


def horizon(now: Column, days: int) -> Column:
    """Midnight so many days ago."""
    return F.date_trunc("day", now) - F.make_dt_interval(days=F.lit(days))


def expired(rows: DataFrame, column: str, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows older than the horizon). Rows without a time are kept."""
    old = F.coalesce(F.col(column) < horizon(now, days), F.lit(False))
    return rows.filter(~old), rows.filter(old)


def due_for_retry(rows: DataFrame, now: Column, most: int = 5, minutes: int = 5, limit: int = 500) -> DataFrame:
    """Failed rows, and rows pending for more than so many minutes, with retries left; in order of id."""
    waiting = (F.col("status") == "PENDING") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return rows.filter((F.col("retry") < most) & ((F.col("status") == "FAILED") | waiting)).orderBy("id").limit(limit)


def stuck(rows: DataFrame, now: Column, minutes: int = 120) -> DataFrame:
    """Runs that are pending or running and haven't changed for so many minutes."""
    return rows.filter(F.col("status").isin("PENDING", "RUNNING") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes))))


def listed(rows: DataFrame, equal: dict | None = None, ranges: dict | None = None) -> DataFrame:
    """Rows by equality and by (from, to) of columns, both ends included. A value or end that is None asks for nothing."""
    for name, value in (equal or {}).items():
        rows = rows if value is None else rows.filter(F.col(name) == value)
    for name, (low, high) in (ranges or {}).items():
        rows = rows if low is None else rows.filter(F.col(name) >= low)
        rows = rows if high is None else rows.filter(F.col(name) <= high)
    return rows


def page(rows: DataFrame, number: int, size: int, key: str = "id") -> DataFrame:
    """A page (from 1) of rows by descending key."""
    return rows.orderBy(F.col(key).desc()).offset((number - 1) * size).limit(size)


def locked_out(logins: DataFrame, now: Column, minutes: int = 15, most: int = 5) -> DataFrame:
    """Users with so many failures in the last minutes and since their last success (an unreachable directory doesn't count)."""
    recent = logins.filter((F.col("at") > now - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("at") <= now))
    success = recent.groupBy("user_id").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"))
    failed = recent.filter(~F.col("ok") & ~F.coalesce(F.col("reason") == "DIRECTORY_UNAVAILABLE", F.lit(False))).join(success, "user_id")
    return failed.filter(F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("failures")).filter(F.col("failures") >= most)


def locked_addresses(logins: DataFrame, now: Column, minutes: int = 15, most: int = 5) -> DataFrame:
    """Addresses (ip) with so many failures in the last minutes, of whatever users; a success in between resets nothing."""
    recent = (F.col("at") > now - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("at") <= now)
    failed = logins.filter(recent & ~F.col("ok") & F.col("ip").isNotNull() & ~F.coalesce(F.col("reason") == "DIRECTORY_UNAVAILABLE", F.lit(False)))
    return failed.groupBy("ip").agg(F.count(F.lit(1)).alias("failures")).filter(F.col("failures") >= most)


def write_archive(old: DataFrame, path: str) -> None:
    """Rows as gzip-compressed JSON lines."""
    old.write.option("compression", "gzip").mode("append").json(path)
