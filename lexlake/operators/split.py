"""Splitting documents into chunks. Packing is sequential within a document, so it runs per row in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexlake.operators.text import CJK
from lexlake.storage import small_batches

_CJK = re.compile(f"[{CJK}]")
#: Ends of segments, kept with them. Fixed values.
_SEGMENT = re.compile(r"[^\n.!?;。！？；]*[\n.!?;。！？；]|[^\n.!?;。！？；]+")
_LOW = "".join(map(chr, range(0x21)))
#: What packed blocks are joined by. Fixed value.
JOINER = "\n"
#: Bytes of chunks that a task holds before they go on.
HELD_BYTES = 4 << 20
Span = tuple[int, int]


def estimate(text: str) -> int:
    """CJK characters, and a quarter of the others rounded up."""
    cjk = len(_CJK.findall(text))
    units = len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2
    return cjk - (cjk - units) // 4


def fitting_prefix(text: str, budget: int) -> int:
    """Length of the longest prefix whose estimate is within budget."""
    cjk = units = 0
    for i, c in enumerate(text):
        cjk, units = cjk + bool(_CJK.match(c)), units + 1 + (c > "\uffff")
        if cjk - (cjk - units) // 4 > budget:
            return i
    return len(text)


def _pieces(text: str, start: int, most: int) -> Iterator[Span]:
    """Segments of text; those above most are cut hard."""
    for m in _SEGMENT.finditer(text):
        a, b = m.span()
        while estimate(text[a:b]) > most:
            n = max(1, fitting_prefix(text[a:b], most))
            yield start + a, start + a + n
            a += n
        if a < b:
            yield start + a, start + b


def fixed_spans(text: str, most: int, overlap: int = 0) -> list[Span]:
    """Chunks of whole segments up to most tokens; each begins with the trailing segments of the last that fit into overlap."""
    out: list[list[Span]] = []
    held: list[Span] = []
    sizes: list[int] = []
    fresh = False
    for a, b in _pieces(text, 0, most):
        n = estimate(text[a:b])
        if held and sum(sizes) + n > most:
            if fresh:
                out.append(held)
            room, keep = min(overlap, most - n), len(held)
            while keep and sum(sizes[keep - 1 :]) <= room:
                keep -= 1
            held, sizes = held[keep:], sizes[keep:]
        held, sizes, fresh = [*held, (a, b)], [*sizes, n], True
    if held and fresh:
        out.append(held)
    return _trimmed(text, [(x[0][0], x[-1][1]) for x in out])


def _trimmed(text: str, spans: list[Span]) -> list[Span]:
    out = []
    for a, b in spans:
        body = text[a:b]
        lead = len(body) - len(body.lstrip(_LOW))
        core = body.strip(_LOW)
        if core:
            out.append((a + lead, a + lead + len(core)))
    return out


Piece = tuple[int | None, int | None, str]


def fixed_pieces(text: str, most: int, overlap: int = 0) -> list[Piece]:
    return [(a, b, text[a:b]) for a, b in fixed_spans(text, most, overlap)]


def packed(blocks: list[str], most: int, overlap: int = 0) -> list[str]:
    """Blocks in a row joined by JOINER while their tokens fit together; one that is too large is split by segments, with overlap. Blank blocks are none."""
    out: list[str] = []
    held: list[str] = []
    room = most
    for block in (b for b in blocks if b.strip()):
        n = estimate(block)
        if held and n > room:
            out.append(JOINER.join(held).strip(_LOW))
            held, room = [], most
        if n > most:
            out += [block[a:b] for a, b in fixed_spans(block, most, overlap)]
        else:
            held.append(block)
            room -= n
    return [*out, JOINER.join(held).strip(_LOW)] if held else out


def separator_pieces(text: str, most: int, overlap: int = 0, separator: str = "\n\n", is_regex: bool = False) -> list[Piece]:
    """What stands between separators, packed. A pattern that doesn't compile is taken literally. Packed chunks have no offsets."""
    try:
        pattern = re.compile(separator if is_regex else re.escape(separator))
    except re.error:
        pattern = re.compile(re.escape(separator))
    edges = [0, *(x for m in pattern.finditer(text) if m.end() > m.start() for x in m.span()), len(text)]
    return [(None, None, c) for c in packed([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)], most, overlap)]


def heading_pieces(text: str, most: int, overlap: int = 0, level: int = 2) -> list[Piece]:
    """Blocks that begin at headings up to a level (2 if it isn't one of 1 to 6), packed; by segments without a heading."""
    starts = [m.start() for m in re.finditer(rf"(?m)^#{{1,{level if 1 <= level <= 6 else 2}}}[ \t\x0b\f\r]", text)]
    if not starts:
        return fixed_pieces(text, most, overlap)
    edges = sorted({0, *starts, len(text) + 1})
    return [(None, None, c) for c in packed([text[a : b - 1] for a, b in zip(edges[:-1], edges[1:], strict=True)], most, overlap)]


def parent_child_spans(text: str, parent: int, child: int, overlap: int = 0) -> list[tuple[Span, list[Span]]]:
    """Parents without overlap, each with its children in the document's offsets, which name exactly their text. A child may not be larger than a parent."""
    if child > parent:
        raise ValueError("a child has no more tokens than its parent")
    out = []
    for a, b in fixed_spans(text, parent):
        out.append(((a, b), [(a + x, a + y) for x, y in fixed_spans(text[a:b], child, overlap)]))
    return out


STRATEGIES: dict[str, Callable[..., list[Piece]]] = {"fixed": fixed_pieces, "separator": separator_pieces, "heading": heading_pieces}


def _cut(rows: DataFrame, cut: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """cut(*row) of each row, its rows in batches of about HELD_BYTES of text: a task never holds more, whatever a batch from Spark has."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(rows.sparkSession)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
        for batch in given:
            for i in range(len(batch)):
                for row in cut(*(c[i].as_py() for c in batch.columns)):
                    held.append(row)
                    size += 100 + 4 * sum(len(x) for x in row if isinstance(x, str))
                    if size > HELD_BYTES:
                        yield packed()
                        held, size = [], 0
        if held:
            yield packed()

    return rows.mapInArrow(batches, schema)


def split_documents(docs: DataFrame, strategy: str = "fixed", most: int = 512, **options) -> DataFrame:
    """Chunks (doc_id, seq, start, stop, content, tokens) of docs (doc_id, text). Null texts have none; packed chunks have no offsets. No shuffle."""
    split = STRATEGIES[strategy]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def chunks(doc, text: str | None) -> Iterator[tuple]:
        for k, (a, b, c) in enumerate(split(text, most, **options) if text and text.strip() else ()):
            yield doc, k, a, b, c, estimate(c)

    return _cut(docs.select("doc_id", "text"), chunks, f"doc_id {kind}, seq int, start int, stop int, content string, tokens int")


def split_parent_child(docs: DataFrame, parent: int = 1024, child: int = 256, overlap: int = 0) -> DataFrame:
    """Two levels (doc_id, parent_seq, seq, start, stop, content): parents have a null seq; children count through the document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def chunks(doc, text: str | None) -> Iterator[tuple]:
        seq = 0
        for p, ((a, b), inner) in enumerate(parent_child_spans(text or "", parent, child, overlap)):
            yield doc, p, None, a, b, text[a:b]
            for x, y in inner:
                yield doc, p, seq, x, y, text[x:y]
                seq += 1

    return _cut(docs.select("doc_id", "text"), chunks, f"doc_id {kind}, parent_seq int, seq int, start int, stop int, content string")


def split_pages(pages: DataFrame, most: int = 512) -> DataFrame:
    """A chunk for each page (doc_id, page_no, text), more where it is too large, with page_no."""
    kind = pages.schema["doc_id"].dataType.simpleString()

    def chunks(doc, page: int, text: str | None) -> Iterator[tuple]:
        yield from ((doc, page, k, c) for k, c in enumerate(packed([text], most) if text else ()))

    return _cut(pages.select("doc_id", "page_no", "text"), chunks, f"doc_id {kind}, page_no int, part int, content string")
