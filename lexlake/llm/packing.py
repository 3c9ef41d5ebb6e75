"""Harmonic packing of tokenised documents into sequences of a fixed length.

Lengths fall into reciprocal-capacity classes: class i holds pieces of floor(capacity / i) tokens, and a bin
of the class holds a fixed number of them, so a bin is full after so many pieces whatever they are. A document
is cut into whole sequences and then, greedily, into the largest class sizes that fit; few pieces suffice, since
what each cut leaves shrinks as its square. Workers fill the bins of each class on their own, seeing only
their rows. What is left in open bins (a bounded number for a worker) is merged in rounds by ever fewer
workers; the last one packs the bounded rest by best fit.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm.pretokens import library_encoder
from lexlake.storage import materialize

CAPACITY = 4096
#: Pieces in open bins that one worker of the next round takes over; it leaves a twentieth of them at most.
MERGED_ROWS = 500_000


@lru_cache(4)
def class_sizes(capacity: int) -> tuple[int, ...]:
    """Piece sizes floor(capacity / i), ascending."""
    return tuple(sorted({capacity // i for i in range(1, capacity + 1)}))


@lru_cache(1 << 16)
def cuts(rest: int, capacity: int) -> tuple[int, ...]:
    """Class sizes that add up to rest (< capacity), largest first."""
    sizes, out = class_sizes(capacity), []
    while rest:
        out.append(sizes[bisect.bisect_right(sizes, rest) - 1])
        rest -= out[-1]
    return tuple(out)


class HarmonicBins:
    """Open bins of one worker. add returns (sequence, pieces) of a bin that fills up, else None."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.open: dict[int, list] = defaultdict(list)

    def add(self, size: int, piece) -> tuple[int, list] | None:
        held = self.open[size]
        held.append(piece)
        if len(held) < self.capacity // size:
            return None
        del self.open[size]
        self.sequence += 1
        return self.sequence - 1, held

    def rest(self) -> list[tuple[int, object]]:
        return [(size, x) for size, held in sorted(self.open.items(), reverse=True) for x in held]


def best_fit(pieces: list[tuple[int, object]], capacity: int) -> list[list[tuple[int, object]]]:
    """Bins for pieces given largest first: each goes where it leaves least room."""
    bins: list[list] = []
    room: list[tuple[int, int]] = []
    for size, piece in pieces:
        k = bisect.bisect_left(room, (size, -1))
        if k == len(room):
            bins.append([])
            left, b = capacity, len(bins) - 1
        else:
            left, b = room.pop(k)
        bins[b].append((size, piece))
        if left > size:
            bisect.insort(room, (left - size, b))
    return bins


_PIECE = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_NAMES = _PIECE.fieldNames()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = np.array(rows, np.int64).reshape(-1, len(_NAMES)).T
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=_NAMES)


def _placed(sequence: int, size: int, held: list[tuple]) -> list[tuple]:
    return [(*piece, sequence, k * size) for k, piece in enumerate(held)]


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str, capacity: int) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, "word")
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for i, j, ids, at in encoder.encode_blocks(batch.column("text")):
                keys, data, at, out = batch.column("key").slice(i, j - i).to_pylist(), ids.astype("<u4").tobytes(), at.tolist(), []
                for k in range(j - i):
                    own = data[4 * at[k] : 4 * at[k + 1]] + end
                    n, p = len(own) // 4, 0
                    for size in (*[capacity] * (n // capacity), *cuts(n % capacity, capacity)):
                        full = bins.add(size, (keys[k], p, size, zlib.crc32(own[4 * p : 4 * (p + size)]), n))
                        if full:
                            out += _placed(full[0], size, full[1])
                        p += size
                if out:
                    yield _batch(out)
        encoder.forget()  # what follows in a pipeline needs the worker's memory
        yield _nullable([(*piece, None, None) for _, piece in bins.rest()])

    return rows.mapInArrow(cut, _PIECE)


def _nullable(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(_NAMES), names=_NAMES)


def _merge(rest: DataFrame, workers: int, round_no: int, capacity: int) -> DataFrame:
    """Fill class bins from what several workers have left; a lone worker also packs the rest of that."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = HarmonicBins(capacity, round_no << 54 | TaskContext.get().partitionId() << 32)
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in _NAMES[:5]), strict=True):
                full = bins.add(row[2], row)
                if full:
                    out += _placed(full[0], row[2], full[1])
            if out:
                yield _batch(out)
        if workers > 1:
            yield _nullable([(*piece, None, None) for _, piece in bins.rest()])
            return
        out = []
        for k, held in enumerate(best_fit(bins.rest(), capacity)):
            at = 0
            for size, piece in held:
                out.append((*piece, bins.sequence + k, at))
                at += size
        if out:
            yield _batch(out)

    return rest.repartition(workers).mapInArrow(fill, _PIECE)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece.

    A document's ids are those of its text by the tokenizer, then end_id; a null or empty text has end_id
    alone. Each id lies in exactly one piece. A repeated row is packed again under the same doc_id; a null key
    stays null. Other columns are not read; an empty table gives no pieces.
    """
    found = materialize(_pieces(docs, tokenizer, end_id, key, text, capacity), "pack-0")
    done, k, workers = [], 0, 0
    while workers != 1:
        done.append(found.filter(F.col("sequence_id").isNotNull()))
        rest = found.filter(F.col("sequence_id").isNull())
        workers, k = max(1, -(-rest.count() // MERGED_ROWS)), k + 1
        found = materialize(_merge(rest, workers, k, capacity), f"pack-{k}")
    return reduce(DataFrame.unionByName, [*done, found])
