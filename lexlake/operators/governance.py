"""Publication of documents: a log of operations folded to each document's state, with illegal ones refused."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Status that each operation needs and the one it leads to. Fixed values.
REVIEWS = {"SUBMIT": (("DRAFT", "REJECTED"), "PENDING_REVIEW"), "APPROVE": (("PENDING_REVIEW",), "PUBLISHED"), "REJECT": (("PENDING_REVIEW",), "REJECTED")}

_STATE = "publish_status string, review_note string, effective_at bigint, expires_at bigint, trashed boolean, trashed_at bigint, purged boolean"
STATE = tuple(x.split()[0] for x in _STATE.split(", "))


class Governed:
    """One document's state. A null status is that of documents from before there were reviews: published."""

    def __init__(self, status: str | None = "DRAFT"):
        self.publish_status, self.review_note, self.effective_at, self.expires_at, self.trashed_at = status or "PUBLISHED", None, None, None, None
        self.trashed = self.purged = False

    def refusal(self, op: str, start: int | None, end: int | None) -> str | None:
        """Why an operation is not allowed now; None where it is."""
        if self.purged:
            return "NOT_FOUND"
        if op == "VALIDITY" and start is not None and end is not None and start >= end:
            return "EMPTY_WINDOW"
        if op in ("RESTORE", "PURGE"):
            return None if self.trashed else "NOT_IN_TRASH"
        if self.trashed:
            return "IN_TRASH"
        if op in REVIEWS:
            return None if self.publish_status in REVIEWS[op][0] else "WRONG_STATUS"
        return None if op in ("VALIDITY", "TRASH") else "UNKNOWN"

    def apply(self, op: str, at: int | None, note: str | None, start: int | None, end: int | None) -> str | None:
        """Take an operation, or say why not."""
        if why := self.refusal(op, start, end):
            return why
        if op in REVIEWS:
            self.publish_status = REVIEWS[op][1]
            self.review_note = {"APPROVE": None, "REJECT": note}.get(op, self.review_note)
        elif op == "VALIDITY":
            self.effective_at, self.expires_at = start, end
        elif op == "PURGE":
            self.purged = True
        else:
            self.trashed, self.trashed_at = op == "TRASH", at if op == "TRASH" else None
        return None


def fold_log(events: DataFrame) -> DataFrame:
    """events (doc_id, event_id, op, at, note, effective_at, expires_at) in order of event_id, each with refused (null: it was taken) and
    the document's state after it.

    Operations: SUBMIT, APPROVE, REJECT, VALIDITY, TRASH, RESTORE, PURGE; documents begin as drafts. A submission keeps the note of
    the rejection before, an approval drops it; a restored document is as it was; what is purged is gone. A document's log is
    read in order by one task, which streams over its documents and holds one state at a time, however long a log is.
    """
    kind = events.schema["doc_id"].dataType.simpleString()
    wanted = ("op", "at", "note", "effective_at", "expires_at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = doc = None
        for batch in batches:
            refused, states = [], []
            for key, *event in zip(*(batch.column(c).to_pylist() for c in ("doc_id", *wanted)), strict=True):
                if held is None or key != doc:
                    held, doc = Governed(), key
                refused.append(held.apply(*event))
                states.append([getattr(held, c) for c in STATE])
            columns = [pa.array(x, t) for x, t in zip(zip(*states, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()), strict=True)] if states else []
            if states:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("event_id"), batch.column("op"), pa.array(refused, pa.string()), *columns], names=["doc_id", "event_id", "op", "refused", *STATE])

    slim = events.select("doc_id", F.col("event_id").cast("long").alias("event_id"), F.col("op").cast("string").alias("op"), F.col("at").cast("long").alias("at"), F.col("note").cast("string").alias("note"), F.col("effective_at").cast("long").alias("effective_at"), F.col("expires_at").cast("long").alias("expires_at"))
    ordered = slim.repartition("doc_id").sortWithinPartitions("doc_id", "event_id", "op")
    return ordered.mapInArrow(fold, f"doc_id {kind}, event_id bigint, op string, refused string, {_STATE}")


def last_states(folded: DataFrame) -> DataFrame:
    """Each document's state after its log, and how many operations were refused. Purged documents stay listed, as purged."""
    return folded.groupBy("doc_id").agg(F.max_by(F.struct(*STATE), "event_id").alias("s"), F.count("refused").alias("refused")).select("doc_id", "s.*", "refused")


def expired_trash(states: DataFrame, horizon: int) -> DataFrame:
    """Documents that a purge takes: in the trash since before the horizon."""
    return states.filter(F.col("trashed") & ~F.col("purged") & (F.col("trashed_at") < horizon))
