"""The degrade rate against a plain count."""

import random

from pyspark.sql import functions as F

from lexlake.operators import usage


def test_degrade_rate_counts_what_a_window_holds(spark):
    dice = random.Random(3)
    rows = [(k, dice.choice(["a", "b", None]), dice.choice([None, *range(-50, 50)]), dice.choice([True, False, None])) for k in range(600)]
    samples = spark.createDataFrame(rows, "id int, source string, at long, degraded boolean").withColumn("ts", F.timestamp_seconds("at"))
    for seconds in (0, 7, 1000):
        got = {r.id: (r.n, r.bad, r.rate) for r in usage.degrade_rate(samples, seconds, 5).collect()}
        assert len(got) == len(rows)
        for k, source, at, _ in rows:
            held = [d for _, s, t, d in rows if s == source and (t is None if at is None else t is not None and at - seconds <= t <= at)]
            known = [d for d in held if d is not None]
            bad = sum(known) if known else None
            assert got[k] == (len(held), bad, bad / len(held) if len(held) >= 5 and known else None)


def test_degrade_rate_is_linear_in_a_window(spark):
    """200,000 samples at as many seconds within one window: summing each window anew takes minutes."""
    samples = spark.range(200_000).select(F.lit("a").alias("source"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 4 == 0).alias("degraded"))
    plan = usage.degrade_rate(samples, 400_000, 1)
    assert "RangeFrame, -400000" not in plan._jdf.queryExecution().toString()
    assert plan.agg(F.max("n"), F.max("bad")).first()[:] == (200_000, 50_000)
