"""Streaming forms against their batch results."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from lexlake.operators import chat
from lexlake.operators.keyed import KeyedTable
from lexlake.streaming import streams


def _stream(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_degrade_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("s", t0 + dt.timedelta(seconds=10 * i), i % 4 == 0) for i in range(60)], "source string, ts timestamp, degraded boolean")
    batch = {(r.start, r.n, r.rate) for r in streams.degrade_windows(df).collect()}
    got = {(r.start, r.n, r.rate) for r in _run(streams.degrade_windows(_stream(spark, df, f"{tmp_path}/in")), "degraded", "complete").collect()}
    assert got == batch and any(rate == 0.25 for _, _, rate in got)


def test_alert_silence(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0 + dt.timedelta(minutes=m), str(m)) for m in (0, 10, 29, 30, 45, 61)] + [("b", t0, "x")], "alert_type string, ts timestamp, content string")
    got = {(r.alert_type, r.content) for r in _run(streams.raise_alerts(_stream(spark, df, f"{tmp_path}/in")), "raised").collect()}
    assert got == {("a", "0"), ("a", "30"), ("a", "61"), ("b", "x")}


def test_upserts(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "chunk_id int, seq int, v string")
    q = streams.upsert_stream(_stream(spark, df, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c")
    q.awaitTermination(120)
    assert {(r.chunk_id, r.v) for r in KeyedTable(spark, f"{tmp_path}/t").read().collect()} == {(1, "b"), (2, "c")}


def test_ledger_keeps_the_first_settlement(spark):
    df = spark.createDataFrame([(1, 5, "RESERVED", 1), (1, 9, "SUCCEEDED", 3), (1, 8, "FAILED", 2), (2, 1, "SUCCEEDED", 7)], "call_id int, ts int, status string, tokens int")
    assert {(r.call_id, r.status) for r in streams.usage_ledger(df).collect()} == {(1, "FAILED"), (2, "SUCCEEDED")}
    assert streams.usage_ledger(df.filter(F.lit(False))).count() == 0


def _files(spark, batches, schema, path):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}")
        time.sleep(0.05 if k else 0)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_chat_windows_as_a_stream(spark, tmp_path):
    """Whatever the order within the allowed lateness, a stream's windows are the table's."""
    r, t0 = random.Random(6), dt.datetime(2024, 1, 1)
    schema = "session_id string, msg_no long, ts timestamp, sender string"
    rows = []
    for s in "abc":
        at = 0
        for n in range(120 if s == "a" else 25):
            at += r.choice([0, 1, 2, 9, 40])
            rows.append((s, n, t0 + dt.timedelta(minutes=at), r.choice(["x", "y", None, " "])))
    rows.sort(key=lambda x: (x[2], r.random()))
    for i in range(0, len(rows) - 5, 5):  # shuffled within a few neighbours, all close in time
        if rows[i + 4][2] - rows[i][2] < dt.timedelta(minutes=25):
            rows[i : i + 5] = r.sample(rows[i : i + 5], 5)
    batches = [rows[i : i + 17] for i in range(0, len(rows), 17)]
    end = [[("end", 0, t0 + dt.timedelta(days=30 + k), "z")] for k in range(3)]
    stream = _files(spark, batches + end, schema, f"{tmp_path}/in")
    table = spark.createDataFrame(rows, schema).withColumn("send_time", F.unix_millis("ts"))
    for n, options in enumerate(({"minutes": 30, "most": 6, "overlap": 2}, {"minutes": 5, "most": 3, "overlap": 0}, {"minutes": 60, "most": 50, "overlap": 10})):
        key = lambda x: (x.session_id, x.seq, x.first_msg, x.last_msg, x.start_time, x.end_time, tuple(x.senders))
        got = sorted(key(x) for x in _run(streams.chat_window_stream(stream, "30 minutes", **options), f"windows{n}").collect() if x.session_id != "end")
        assert got == sorted(key(x) for x in chat.chat_windows(table, **options).collect())


def test_token_buckets_as_a_stream(spark, tmp_path):
    """A key with most of all rows and some with few; state is carried from batch to batch."""
    r, t0 = random.Random(7), dt.datetime(2024, 1, 1)
    schema, at, rows = "key string, ts timestamp, n long", 0, []
    for n in range(400):
        at += r.choice([0, 1, 90, 300, 5_000])
        rows.append((r.choice("aaaab"), t0 + dt.timedelta(milliseconds=at), n))
    rows.append(("a", t0 + dt.timedelta(hours=1), 400))
    stream = _files(spark, [rows[i : i + 60] for i in range(0, len(rows), 60)], schema, f"{tmp_path}/in")
    count = lambda df: sorted((x.key, x.ts, sum(y.allowed for y in df if (y.key, y.ts) == (x.key, x.ts))) for x in df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        table = streams.rate_limit(spark.createDataFrame(rows, schema), 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert count(_run(streams.rate_limit(stream, 3), "buckets").collect()) == count(table)
    for k in "ab":
        mine = sorted((x.ts, x.n, x.allowed) for x in table if x.key == k)
        assert sum(a for *_, a in mine) == sum(streams.bucket_decisions([int(t.timestamp() * 1000) for t, *_ in mine], 3.0))


def test_odd_requests(spark):
    t0 = dt.datetime(2024, 1, 1)
    got = streams.rate_limit(spark.createDataFrame([(None, t0, 1), (None, t0, 2), ("a", None, 3)], "key string, ts timestamp, n long"), 1).collect()
    assert {(x.n, x.allowed) for x in got} == {(1, True), (2, False), (3, False)}


def test_repeated_batches_change_nothing(spark, tmp_path):
    """Batches are laid one over the other; a query begun anew after a lost checkpoint lays none of them twice."""
    schema = "chunk_id int, seq int, v string"
    stream = _files(spark, [[(1, 1, "a"), (2, 5, "b")], [(1, 2, "c"), (2, 4, "d")], [(3, 1, "e")]], schema, f"{tmp_path}/in")
    for k in range(2):
        streams.upsert_stream(stream, f"{tmp_path}/t", f"{tmp_path}/c{k}").awaitTermination(120)
        table = KeyedTable(spark, f"{tmp_path}/t")
        assert table.version() == 2 and {(x.chunk_id, x.v) for x in table.read().collect()} == {(1, "c"), (2, "b"), (3, "e")}
