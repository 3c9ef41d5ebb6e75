"""Chat sessions: windows, near-duplicate windows, rendering and session matching."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexlake.operators.text import message_type, parse_time_ms, truthy

#: Windows that a task holds before they go on, whole sessions at a time.
MERGED_HELD = 5_000


class OpenWindow:
    """A session's window that is still open: fed messages in order of time, it gives those that close.

    A window opens at a message and closes before the one that comes minutes or more after its first with a time, or
    after most messages; the next begins overlap messages before its end, one further on at least. At most most + 1
    messages are held.
    """

    def __init__(self, minutes: float, most: int, overlap: int, seq: int = 0, first: int = 0, closed: bool = False, times: list | None = None, senders: list | None = None):
        self.span, self.most, self.overlap = int(minutes * 60_000), most, max(0, min(overlap, (most - 1) // 2))
        self.seq, self.first, self.closed = seq, first, closed
        self.times, self.senders = list(times or ()), list(senders or ())

    def _row(self, n: int) -> tuple:
        known = [t for t in self.times[:n] if t is not None]
        return self.seq, self.first, self.first + n - 1, min(known, default=None), max(known, default=None), list(dict.fromkeys(self.senders[:n]))

    def _end(self) -> int:
        start = next((t for t in self.times if t is not None), None)
        for n, t in enumerate(self.times):
            if n == self.most or (start is not None and t is not None and t - start >= self.span):
                return n
        return len(self.times)

    def add(self, time: int | None, sender: str | None) -> list[tuple]:
        """(seq, first, last, start, end, senders) of the windows that this message closes. A blank sender is unknown."""
        self.times.append(time)
        self.senders.append(sender if sender is not None and sender.strip() else "unknown")
        out = []
        while (n := self._end()) < len(self.times):
            if not self.closed:
                out.append(self._row(n))
                self.seq += 1
            self.closed = False
            step = max(1, n - self.overlap)
            self.first += step
            del self.times[:step], self.senders[:step]
        return out

    def due(self) -> int | None:
        """The time from which on no message can join what is open; None where nothing is or there is no time."""
        start = next((t for t in self.times if t is not None), None)
        return None if self.closed or start is None else start + self.span

    def close(self) -> list[tuple]:
        """The open window, since no message can join it any more. What a later one overlaps stays."""
        if self.closed or not self.times:
            return []
        out = [self._row(len(self.times))]
        self.seq, self.closed = self.seq + 1, True
        return out


#: What windows are made of, beside session_id.
WINDOW = "seq int, first_msg int, last_msg int, start_time bigint, end_time bigint, senders array<string>"


def chat_windows(messages: DataFrame, minutes: float = 60, most: int = 50, overlap: int = 0) -> DataFrame:
    """Windows of each session of messages (session_id, msg_no, send_time ms, sender): seq, span, times, distinct senders.

    Where a window ends depends on where it began, so a session is read in order by one task; window() and session_window()
    close on other rules. The task streams over its sessions and holds one open window at a time, however long a session
    is. Without a time a message comes last, in order of msg_no.
    """
    kind = messages.schema["session_id"].dataType.simpleString()
    names = ["session_id", *(x.split()[0] for x in WINDOW.split(", "))]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = session = None

        def packed(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
            kinds = [like.field("session_id").type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        schema = None
        for batch in batches:
            rows, schema = [], batch.schema
            for key, time, sender in zip(*(batch.column(c).to_pylist() for c in ("session_id", "send_time", "sender")), strict=True):
                if held is None or key != session:
                    rows += [(session, *r) for r in held.close()] if held else []
                    held, session = OpenWindow(minutes, most, overlap), key
                rows += [(session, *r) for r in held.add(time, sender)]
            if rows:
                yield packed(rows, schema)
        if held:
            yield packed([(session, *r) for r in held.close()], schema)

    slim = messages.select("session_id", F.col("msg_no"), F.col("send_time").cast("long").alias("send_time"), F.col("sender").cast("string").alias("sender"))
    ordered = slim.repartition("session_id").sortWithinPartitions("session_id", F.col("send_time").asc_nulls_last(), "msg_no")
    return ordered.mapInArrow(windows, f"session_id {kind}, {WINDOW}")


def render(messages: DataFrame) -> DataFrame:
    """Each session's lines ``[time] sender: content`` in order."""
    stamp = F.date_format(F.timestamp_millis("send_time"), "yyyy-MM-dd HH:mm:ss")
    line = F.concat(F.lit("["), F.coalesce(stamp, F.lit("")), F.lit("] "), F.coalesce("sender", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")))
    held = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(F.col("send_time").isNull().alias("late"), "send_time", "msg_no", line.alias("line")))).alias("l"))
    return held.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def merge_near_windows(ranked: DataFrame, share: float = 0.5, most: int = 5) -> DataFrame:
    """Ranked windows (query_id, position, chunk_id, session_id, first_msg, last_msg) without those that an earlier kept one of the
    session overlaps by share of the shorter; absorbed lists up to most of them. Hits without a session stay.

    Which are kept depends on those before, so a query's hits in a session are read in order. Sessions are sorted and streamed, many
    to a batch; a task holds the kept windows of one.
    """
    inner = [c for c in ranked.columns if c not in ("query_id", "session_id")]
    spans = ranked.select("query_id", "session_id", "position", F.col("chunk_id").cast("string").alias("chunk_id"), "first_msg", "last_msg", F.struct(*inner).alias("__row"))
    schema = StructType([*spans.select("query_id", "session_id", "__row").schema, StructField("absorbed", ArrayType(StringType()))])
    kinds = to_arrow_schema(schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, kept = None, NearWindows(share, most)
        rows: list[pa.RecordBatch] = []
        absorbed: list[list] = []

        def packed() -> Iterator[pa.RecordBatch]:
            if rows:
                whole = pa.concat_batches(rows)
                yield pa.RecordBatch.from_arrays([*(whole.column(n).cast(kinds.field(n).type) for n in kinds.names[:-1]), pa.array(absorbed, kinds[-1].type)], schema=kinds)

        for batch in batches:
            names = [batch.column(n).to_pylist() for n in ("query_id", "session_id", "chunk_id", "first_msg", "last_msg")]
            mine = []
            for i, (q, x, chunk, first, last) in enumerate(zip(*names, strict=True)):
                if (q, x) != session:
                    if len(absorbed) > MERGED_HELD:
                        if mine:
                            rows.append(batch.take(pa.array(mine)).select(kinds.names[:-1]))
                        yield from packed()
                        rows, absorbed, mine = [], [], []
                    session, kept = (q, x), NearWindows(share, most)
                found = kept.add(chunk, first, last)
                if found is not None:
                    mine.append(i)
                    absorbed.append(found)
            if mine:
                rows.append(batch.take(pa.array(mine)).select(kinds.names[:-1]))
        yield from packed()

    held = spans.filter("session_id IS NOT NULL").repartition("query_id", "session_id").sortWithinPartitions("query_id", "session_id", F.col("position").asc_nulls_last())
    out = held.mapInArrow(merge, schema)
    found = out.select(*(F.col(c) if c in ("query_id", "session_id") else F.col("__row")[c].alias(c) for c in ranked.columns), "absorbed")
    return found.unionByName(ranked.filter("session_id IS NULL").withColumn("absorbed", F.array().cast("array<string>")))


class NearWindows:
    """The windows of one session that were kept so far.

    Kept ones overlap each other by less than share of the shorter, so none lies in another: by their first message they are
    in order of their last as well, and those that a new one meets are neighbours. What is no window, and any share out of 0 to 1, is compared with all.
    """

    def __init__(self, share: float, most: int) -> None:
        self.share, self.most, self.plain = share, most, not 0 < share <= 1
        self.windows: list[tuple[int, int]] = []
        self.absorbed: list[list[str]] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.place: list[int] = []

    def _near(self, k: int, a: int, b: int) -> bool:
        x, y = self.windows[k]
        return min(b, y) - max(a, x) + 1 >= self.share * (min(b - a, y - x) + 1)

    def add(self, chunk: str, first: int | None, last: int | None) -> list | None:
        """A list that later windows' chunks go to, if this one is kept."""
        if first is None or last is None:
            return []
        if first > last and not self.plain:
            self.plain = True
        if self.plain:
            host = next((k for k in range(len(self.windows)) if self._near(k, first, last)), None)
        else:
            met = self.place[bisect_left(self.last, first) : bisect_right(self.first, last)]
            host = min((k for k in met if self._near(k, first, last)), default=None)
        if host is not None:
            if len(self.absorbed[host]) < self.most:
                self.absorbed[host].append(chunk)
            return None
        if not self.plain:
            at = bisect_left(self.first, first)
            self.first.insert(at, first)
            self.last.insert(at, last)
            self.place.insert(at, len(self.windows))
        self.windows.append((first, last))
        self.absorbed.append([])
        return self.absorbed[-1]


def session_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.min("send_time").alias("first_time"), F.max("send_time").alias("last_time"))


def match_sessions(sessions: DataFrame, documents: DataFrame) -> DataFrame:
    """CREATE for a session without a document of its source_key, else NEW_VERSION of that document."""
    known = documents.select(F.col("source_key").alias("session_id"), "doc_id")
    return sessions.join(known, "session_id", "left").withColumn("action", F.when(F.col("doc_id").isNull(), "CREATE").otherwise("NEW_VERSION"))


def txt_messages(lines: DataFrame, header: str = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\S+)$") -> DataFrame:
    """Messages of exported text (file, line_no, line): a header line starts one, lines up to the next are its content."""
    order = W.partitionBy("file").orderBy("line_no")
    marked = lines.withColumn("h", F.col("line").rlike(header)).withColumn("msg_no", F.sum(F.col("h").cast("int")).over(order)).filter("msg_no > 0")
    held = marked.groupBy("file", "msg_no").agg(F.max(F.when(F.col("h"), F.col("line"))).alias("head"), F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("line_no", "line")))).alias("l"))
    return held.select("file", "msg_no", F.regexp_extract("head", header, 1).alias("time"), F.regexp_extract("head", header, 2).alias("sender"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


#: Share of a text export's lines that may come before any message; what a session without a name is called. Fixed values.
MOST_UNMATCHED, NO_SESSION = 0.30, "default"
#: Header lines of text exports: a pattern, and the numbers of its groups for time, sender and content (0: none). Fixed values.
HEADERS = ((r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (\S.*)$", 1, 2, 0), (r"^(.+?) \((\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\):(.*)$", 2, 1, 3))


def txt_sessions(lines: DataFrame, headers: tuple = HEADERS) -> tuple[DataFrame, DataFrame]:
    """(messages, files) of exported text (file, line_no, line).

    A line that one of the headers matches (the first that does) and whose time can be read starts a message; lines up to the next
    belong to it. Header lines without a readable time are skipped, blank lines count for nothing. files: how many lines were
    looked at, came before any message (unmatched), were skipped, and failed: more than MOST_UNMATCHED of the lines
    unmatched, most likely since no header fits. messages (file, msg_id, sender, send_time, content) of the other files.
    """
    picked = lambda k: F.coalesce(*(F.when(F.col("line").rlike(h[0]), F.regexp_extract("line", h[0], h[k]) if h[k] else F.lit("")) for h in headers))
    seen = lines.filter(F.trim(F.regexp_replace("line", r"\s+", " ")) != "").select("file", "line_no", "line", picked(1).alias("time"), picked(2).alias("sender"), picked(3).alias("inline"))
    timed = seen.withColumn("send_time", parse_time_ms(F.col("time")))
    starts, skipped = F.col("send_time").isNotNull(), F.col("time").isNotNull() & F.col("send_time").isNull()
    order = W.partitionBy("file").orderBy("line_no")
    marked = timed.withColumn("kind", F.when(starts, "START").when(skipped, "SKIPPED").otherwise("MORE")).withColumn("msg_no", F.sum(starts.cast("int")).over(order))
    files = marked.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if((F.col("kind") == "MORE") & (F.col("msg_no") == 0)).alias("unmatched"), F.count_if(F.col("kind") == "SKIPPED").alias("skipped"))
    files = files.withColumn("failed", F.col("unmatched") / F.col("lines") > MOST_UNMATCHED)
    body = F.when(F.col("kind") == "MORE", F.col("line")).when(F.trim("inline") != "", F.col("inline"))
    held = marked.filter("msg_no > 0 AND kind <> 'SKIPPED'").groupBy("file", "msg_no").agg(F.max("send_time").alias("send_time"), F.max("sender").alias("sender"), F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("line_no", body.alias("line"))))).alias("l"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    messages = held.join(files.filter("NOT failed").select("file"), "file", "left_semi")
    return messages.select("file", F.concat_ws("-", F.col("file").cast("string"), F.col("msg_no").cast("string")).alias("msg_id"), strip(F.coalesce("sender", F.lit(""))).alias("sender"), "send_time", strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("content")), files


def mapped_columns(columns: list[str], candidates: dict[str, list[str]], required: tuple[str, ...] = ()) -> dict[str, str | None]:
    """Of each standard column's candidate headers the first there, whatever its case and spaces. A required one without any is an error."""
    key = lambda c: "".join(c.split()).lower()
    have = {key(c): c for c in columns}
    out = {name: next((have[key(o)] for o in options if key(o) in have), None) for name, options in candidates.items()}
    if lacking := [name for name in required if out.get(name) is None]:
        raise ValueError(f"no column for {', '.join(lacking)}")
    return out


def map_columns(raw: DataFrame, candidates: dict[str, list[str]]) -> DataFrame:
    """raw with standard columns, as mapped_columns finds them; content and send_time are required."""
    found = mapped_columns(raw.columns, candidates, ("content", "send_time"))
    return raw.select(*((F.lit(None).cast("string") if c is None else F.col(f"`{c}`").cast("string")).alias(name) for name, c in found.items()))


def table_messages(raw: DataFrame, candidates: dict[str, list[str]], file: str = "file", row_no: str = "row_no") -> tuple[DataFrame, DataFrame]:
    """(messages, skipped) of the rows of exported tables: raw has file, row_no (from 0) and the tables' own columns.

    candidates: headers of session_id, session_name, msg_id, sender, is_self, send_time, msg_type and content, which alone is required.
    Rows without any value are none. Voice and video messages and those without a readable time are left out; skipped counts them by
    file. A message without a session is of NO_SESSION, one without an id gets its session's name and row number.
    """
    own = [c for c in raw.columns if c not in (file, row_no)]
    found = mapped_columns(own, candidates, ("content",))
    blank = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    value = lambda name: F.lit(None).cast("string") if found.get(name) is None else blank(F.col(f"`{found[name]}`").cast("string"))
    some = F.coalesce(*(blank(F.col(f"`{c}`").cast("string")) for c in own)).isNotNull()
    rows = raw.filter(some).select(F.col(file).alias("file"), F.col(row_no).alias("row_no"), *(value(n).alias(n) for n in ("session_id", "session_name", "msg_id", "sender", "is_self", "content")), message_type(value("msg_type")).alias("msg_type"), parse_time_ms(value("send_time")).alias("send_time"))
    kept = ~F.col("msg_type").isin("voice", "video") & F.col("send_time").isNotNull()
    skipped = rows.groupBy("file").agg(F.count_if(F.col("msg_type") == "voice").alias("voice"), F.count_if(F.col("msg_type") == "video").alias("video"), F.count_if(~F.col("msg_type").isin("voice", "video") & F.col("send_time").isNull()).alias("other"))
    session = F.coalesce("session_id", F.lit(NO_SESSION))
    messages = rows.filter(kept).select(
        "file", session.alias("session_id"), F.coalesce("session_name", session).alias("session_name"), F.coalesce("msg_id", F.concat_ws("-", session, F.col("row_no").cast("string"))).alias("msg_id"),
        F.coalesce("sender", F.lit("")).alias("sender"), truthy(F.col("is_self")).alias("is_self"), "send_time", "msg_type", F.coalesce("content", F.lit("")).alias("content"),
    )
    return messages, skipped


def conversation_messages(conversations: DataFrame, spacing_ms: int = 60_000) -> DataFrame:
    """Messages of a conversations table (conv_id, turn, role, text), a minute apart."""
    return conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("msg_no"), (F.col("turn") * spacing_ms).cast("long").alias("send_time"), F.col("role").alias("sender"), F.col("text").alias("content"))
