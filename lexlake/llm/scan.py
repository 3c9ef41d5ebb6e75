"""Vectorised scanning of text inside Spark tasks.

Arrow hands a task whole columns of UTF-8; the functions here cut them into blocks of bounded
size and find and hash words with numpy, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; work arrays take about 40 times as much, and as much of a single longer text.
BLOCK = 1 << 19
U64 = np.uint64
#: Values that are hashed together, and places within a span whose keys are kept ready.
SECTION, READY = 1 << 18, 1 << 12


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values, one to one."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _key(place: np.ndarray) -> np.ndarray:
    """An odd 64-bit key of its own for each place within a span."""
    return mix((place.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)) | U64(1)


def _spread(values: np.ndarray) -> np.ndarray:
    return mix(values.astype(U64) + U64(0xD1B54A32D192ED03))


_KEYS, _VALUES = _key(np.arange(READY)), _spread(np.arange(1 << 16))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal content wherever it lies. Spans ascend and don't overlap.

    Each value is scattered, multiplied by the key of its place and summed: a multilinear hash. Its keys follow no
    rule in common as powers of one base do, so no family of texts collides by its structure. Sections bound the memory.
    """
    total = np.zeros(len(starts), U64)
    for a in range(0, len(values), SECTION):
        b = min(a + SECTION, len(values))
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if lo >= hi:
            continue
        s, e = np.maximum(starts[lo:hi], a), np.minimum(ends[lo:hi], b)
        at, part = int(s[0]), values[s[0] : b]
        place = np.arange(at, b) - np.repeat(starts[lo:hi], np.diff(np.append(s, b)))
        key = _KEYS[np.minimum(place, READY - 1)]
        far = place >= READY
        if far.any():
            key[far] = _key(place[far])
        key *= _VALUES[part] if part.dtype == np.uint8 or part.dtype != U64 and part.max() < len(_VALUES) else _spread(part)
        sums = np.zeros(len(key) + 1, U64)
        np.cumsum(key, out=sums[1:])
        total[lo:hi] += sums[np.maximum(e, at) - at] - sums[s - at]
    return mix(total + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def counted(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags hold between the offsets."""
    if len(at) == 2:
        return np.array([np.count_nonzero(flags)])
    return np.diff(np.append(0, np.cumsum(flags))[at])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about limit bytes.

    A longer text forms a run of its own.
    """
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where inside holds, cut at the offsets."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = offsets[(offsets > 0) & (offsets < n)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: hashes, starts, ends, and each text's first word (n + 1)."""
    starts, ends = spans(~WHITE[data], offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
