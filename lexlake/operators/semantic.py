"""Splitting where a model says so: units of a text in windows that overlap, proposed cuts, and what becomes of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.operators.split import _SEGMENT, Span, estimate, fixed_spans

#: A window holds as many units as the first that reach so many chunks' tokens; units that the next one sees once more. Fixed values.
FACTOR, OVERLAP = 8, 2


def unit_spans(text: str) -> list[Span]:
    """Units: what runs up to the end of a sentence or line, that included."""
    return [m.span() for m in _SEGMENT.finditer(text)]


def windows(sizes: list[int], most: int) -> list[tuple[int, int, int]]:
    """(first unit, unit after the last, how many of its first the window before has) of each window over units of these tokens.

    All windows have as many units as the first, which ends with the unit that reaches FACTOR * most; each after it
    begins OVERLAP before the end of the last and holds one new unit at least.
    """
    total = budget = 0
    for n in sizes:
        total, budget = total + n, budget + 1
        if total >= most * FACTOR:
            break
    out, at = [], 0
    while at < len(sizes):
        shared = min(OVERLAP, at)
        end = min(len(sizes), max(at - shared + max(1, budget), at + 1))
        out.append((at - shared, end, shared))
        at = end
    return out


def read_answer(answer: str | None, units: int, shared: int) -> tuple[list[int], list] | None:
    """(cuts, what is said of each chunk) of a model's answer {"cuts": [...], "chunks": [...]}, fenced or not; None if it is of no use.

    Cuts are numbers of the window's units after which a chunk ends: ascending, among the new ones, and none the last.
    """
    body = (answer or "").strip()
    if body.startswith("```") and "\n" in body and body.rfind("```") > body.find("\n"):
        body = body[body.find("\n") + 1 : body.rfind("```")].strip()
    try:
        said = json.loads(body)
        cuts = said["cuts"]
        fine = all(isinstance(c, int) and not isinstance(c, bool) for c in cuts) and all(a < b for a, b in zip([shared - 1, *cuts], [*cuts, units - 1], strict=True))
    except (ValueError, TypeError, KeyError):
        return None
    # Without a cut the window is one chunk, however few units it has.
    return (cuts, said.get("chunks") or []) if fine or not cuts else None


def window_chunks(text: str, spans: list[Span], window: tuple[int, int, int], answer: str | None, most: int) -> list[tuple[int, int, bool, dict]]:
    """(start, stop, whether the model's, what it says of it) of a window's new units: by its cuts, or by length where they are of no use."""
    first, end, shared = window
    new = spans[first + shared : end]
    said = read_answer(answer, end - first, shared)
    if said is None:
        base = new[0][0]
        return [(base + a, base + b, False, {}) for a, b in fixed_spans(text[base : new[-1][1]], most)]
    cuts, notes = said
    out, at = [], first + shared
    for k, cut in enumerate([*cuts, end - first - 1]):
        a, b = spans[at][0], spans[first + cut][1]
        body = text[a:b]
        core = body.strip("".join(map(chr, range(0x21))))
        if core:
            a += body.find(core)
            note = notes[k] if k < len(notes) and isinstance(notes[k], dict) else {}
            out.append((a, a + len(core), True, note))
        at = first + cut + 1
    return out


def semantic_windows(docs: DataFrame, most: int = 512) -> DataFrame:
    """(doc_id, window_no, shared, units, listing) of docs (doc_id, text): what a model is asked to cut, a numbered line for each unit.

    Null and blank texts have no windows. Asking the model is the caller's.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = unit_spans(t) if t and t.strip() else []
                for n, (a, b, shared) in enumerate(windows([estimate(t[x:y]) for x, y in spans], most)):
                    rows.append((d, n, shared, b - a, "".join(f"{k}: {t[x:y].strip()}\n" for k, (x, y) in enumerate(spans[a:b]))))
            kinds = batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.int32(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "window_no", "shared", "units", "listing"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(listed, f"doc_id {kind}, window_no int, shared int, units int, listing string")


def split_semantic(docs: DataFrame, answers: DataFrame, most: int = 512) -> DataFrame:
    """Chunks (doc_id, seq, start, stop, content, tokens, by_model, title, summary, keywords) of docs (doc_id, text).

    answers (doc_id, window_no, answer): a model's answers to semantic_windows with the same most. A window whose answer is missing,
    no JSON, without cuts, or with a cut that is out of order, among the units shared with the window before, or at its
    end, is split by length; the others stay as the model has them. Of several answers to a window the least counts. A
    document's answers go to it by one join; a text is never gathered with others.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    once = answers.filter("window_no IS NOT NULL").groupBy("doc_id", "window_no").agg(F.min("answer").alias("answer"))
    held = once.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("window_no").cast("int"), F.col("answer").cast("string")))).alias("answers"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "seq", "start", "stop", "content", "tokens", "by_model", "title", "summary", "keywords"]
        for batch in batches:
            rows: list[tuple] = []
            for d, t, said in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "answers")), strict=True):
                spans, known = unit_spans(t) if t and t.strip() else [], dict(said or ())
                found = [c for n, w in enumerate(windows([estimate(t[x:y]) for x, y in spans], most)) for c in window_chunks(t, spans, w, known.get(n), most)]
                for seq, (a, b, own, note) in enumerate(found):
                    word = lambda k: str(note[k]) if note.get(k) is not None else None  # noqa: B023, E731
                    keys = note.get("keywords")
                    rows.append((d, seq, a, b, t[a:b], estimate(t[a:b]), own, word("title"), word("summary"), [str(x) for x in keys] if isinstance(keys, list) and keys else None))
            kinds = batch.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    both = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(held, "doc_id", "left")
    return both.mapInArrow(chunks, f"doc_id {kind}, seq int, start int, stop int, content string, tokens int, by_model boolean, title string, summary string, keywords array<string>")
