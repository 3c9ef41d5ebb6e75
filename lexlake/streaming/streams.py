"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lexlake.operators.chat import WINDOW, OpenWindow
from lexlake.operators.keyed import KeyedTable


def degrade_windows(samples: DataFrame, size: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", least: int = 20) -> DataFrame:
    """Share of degraded samples (source, ts, degraded) in sliding windows; null below least samples. Works on streams and tables."""
    rows = samples.withWatermark("ts", late) if samples.isStreaming else samples
    held = rows.groupBy("source", F.window("ts", size, slide)).agg(F.count(F.lit(1)).alias("n"), F.count_if("degraded").alias("bad"))
    return held.select("source", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", F.when(F.col("n") >= least, F.col("bad") / F.col("n")).alias("rate"))


def raise_alerts(alerts: DataFrame, silence_minutes: int = 30) -> DataFrame:
    """Alerts (alert_type, ts, content) of a stream that aren't within the silence after the last one raised of their type."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        kept = []
        for row in rows.itertuples(index=False):
            at = int(row.ts.timestamp() * 1000)
            if last is None or at >= last + silence_minutes * 60_000:
                kept.append(row)
                last = at
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=rows.columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.schema)
    return alerts.groupBy("alert_type").applyInPandasWithState(admit, schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


class TokenBucket:
    """A key's bucket: full at first, refilled by the time between requests, never above what it holds."""

    def __init__(self, rate: float, tokens: float | None = None, last: int | None = None):
        self.rate, self.tokens, self.last = rate, rate if tokens is None else tokens, last

    def take(self, at: int) -> bool:
        """Whether a request at this time (ms) finds a token. A time before the last one refills nothing."""
        if self.last is None or at > self.last:
            self.tokens = self.tokens if self.last is None else min(self.rate, self.tokens + (at - self.last) / 1000 * self.rate)
            self.last = at
        taken = self.tokens >= 1
        self.tokens -= taken
        return taken


def bucket_decisions(times: list[int], rate: float) -> list[bool]:
    """Whether each request (sorted times in ms) of a key finds a token."""
    bucket = TokenBucket(rate)
    return [bucket.take(t) for t in times]


def _millis(ts: str = "ts") -> F.Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def rate_limit(requests: DataFrame, qps: int = 5, idle: str = "10 minutes") -> DataFrame:
    """requests (key, ts) with allowed, by a token bucket for each key that holds max(1, qps) tokens. Works on streams and tables.

    A table is read in order of time: a task streams over its keys and holds one bucket at a time, so a key may have any
    share of all rows. A stream decides each request when it comes, in order of time within a micro-batch; a key's bucket is
    state, dropped once the watermark is idle past its last request (it would be full again by then). Requests of equal
    times are alike, so which of them gets a token is settled by their other columns in a table. A null key is a key; a
    request without a time is refused.
    """
    rate = float(max(1, qps))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", allowed boolean"
    if requests.isStreaming:
        return _rate_limit_stream(requests, rate, idle, schema)

    def limit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key = None
        for batch in batches:
            allowed = []
            for k, at in zip(batch.column("key").to_pylist(), batch.column("__at").to_pylist(), strict=True):
                if bucket is None or k != key:
                    bucket, key = TokenBucket(rate), k
                allowed.append(at is not None and bucket.take(at))
            yield batch.drop_columns(["__at"]).append_column("allowed", pa.array(allowed, pa.bool_()))

    rest = [F.col(f"`{c}`") for c, t in requests.dtypes if c not in ("key", "ts") and not t.startswith(("map", "variant"))]
    ordered = requests.withColumn("__at", _millis()).repartition("key").sortWithinPartitions("key", "__at", *rest)
    return ordered.mapInArrow(limit, schema)


def _rate_limit_stream(requests: DataFrame, rate: float, idle: str, schema: str) -> DataFrame:
    ttl = int(pd.Timedelta(idle).total_seconds() * 1000)

    def limit(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        bucket = TokenBucket(rate, *(state.get if state.exists else ()))
        rows["allowed"] = [not pd.isna(t) and bucket.take(int(t.timestamp() * 1000)) for t in rows["ts"]]
        if bucket.last is not None:
            state.update((bucket.tokens, bucket.last))
            state.setTimeoutTimestamp(max(bucket.last, state.getCurrentWatermarkMs()) + ttl)
        yield rows

    timed = requests.withWatermark("ts", idle)
    return timed.groupBy("key").applyInPandasWithState(limit, schema, "tokens double, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def chat_window_stream(messages: DataFrame, late: str = "10 minutes", minutes: float = 60, most: int = 50, overlap: int = 0) -> DataFrame:
    """The windows of chat.chat_windows over a stream of messages (session_id, msg_no, ts timestamp, sender), each when it closes.

    A session's state is what waits for the watermark (messages at most late behind the newest) and its open window of at
    most most + 1 messages. Messages are taken in order of time and msg_no once the watermark passes them, so the order in which
    they come within late changes nothing; later ones are dropped, as are those without a time. A window closes by the
    message after it, or by a timer when the watermark has passed all that could join it.
    """
    kind = messages.schema["session_id"].dataType.simpleString()

    def windows(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, first, closed, times, senders, ats, numbers, names = state.get if state.exists else (0, 0, False, [], [], [], [], [])
        held = OpenWindow(minutes, most, overlap, seq, first, closed, times, senders)
        waiting = list(zip(ats, numbers, names, strict=True))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += [(int(t), int(n), s) for t, n, s in zip(rows["at"], rows["msg_no"], rows["sender"], strict=True)]
        passed = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda x: x[:2])
        out = []
        while waiting and waiting[0][0] <= passed:
            at, _, sender = waiting.pop(0)
            out += held.add(at, sender)
        due = held.due()
        if due is not None and passed >= due - 1:
            out += held.close()
            due = None
        ats, numbers, names = ([x[k] for x in waiting] for k in range(3))
        state.update((held.seq, held.first, held.closed, held.times, held.senders, ats, numbers, names))
        if next_at := min([*ats[:1], *([due - 1] if due is not None else [])], default=None):
            state.setTimeoutTimestamp(max(next_at, passed + 1))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["session_id", "seq", "first_msg", "last_msg", "start_time", "end_time", "senders"])

    timed = messages.filter("ts IS NOT NULL").withWatermark("ts", late).withColumn("at", _millis()).select("session_id", F.col("msg_no").cast("long").alias("msg_no"), "ts", "at", F.col("sender").cast("string").alias("sender"))
    held = "seq int, first int, closed boolean, times array<bigint>, senders array<string>, ats array<bigint>, numbers array<bigint>, names array<string>"
    return timed.groupBy("session_id").applyInPandasWithState(windows, f"session_id {kind}, {WINDOW}", held, "append", GroupStateTimeout.EventTimeTimeout)


def usage_ledger(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """First settlement of each call (call_id, ts, status, tokens): later ones, and repeats, change nothing."""
    settled = events.filter(F.col("status").isin("SUCCEEDED", "FAILED"))
    if events.isStreaming:
        return settled.withWatermark("ts", late).dropDuplicatesWithinWatermark(["call_id"])
    return settled.groupBy("call_id").agg(F.min_by(F.struct("ts", "status", "tokens"), F.struct("ts", "status")).alias("s")).select("call_id", "s.*")


def upsert_stream(changes: DataFrame, path: str, checkpoint: str, key: str = "chunk_id", order: str = "seq"):
    """A query that lays each micro-batch over the KeyedTable at path. A batch that is repeated after a failure changes nothing."""
    table = KeyedTable(changes.sparkSession, path, key, order)

    def lay(batch: DataFrame, n: int) -> None:
        table.lay(batch, n)

    return changes.writeStream.foreachBatch(lay).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
