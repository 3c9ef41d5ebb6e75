"""Toxicity by class-conditional Kneser-Ney language models.

Two bigram models, of toxic and of ordinary text, interpolate to the class's own word distribution and that to
one both share. All levels count continuations: a pair of words counts once for each word seen before it, a word for each
word before it, and in the shared distribution for each class it occurs in. So copies of a text count once, and expressions
rare in both classes say little for either. A text is judged by its log-likelihood ratio per word and by that of its
most telling words.

The models are tables with a row for every pair and every word of the labelled rows; nothing is cut, and no task holds them whole.
They are packed by bucket once, and each table goes from the disk as soon as what is made of it is written.
Texts ask them: a chunk of texts sends the keys of its distinct pairs and words to the buckets of these keys, the
buckets answer in the same order, and chunk and answers meet again. Words are known by 48 bits of their hash, pairs by 56, the word before a pair by 30.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm.scan import LOWER, U64, blocks, mix, span_hashes, spans
from lexlake.storage import BROADCAST_ROWS, discard, materialize

WORD_BITS, KEY_BITS, BEFORE_BITS = 48, 56, 30
#: Words never seen, of which the shared distribution thinks each as half a word, as it adds half a word to those seen.
UNSEEN = 1 << 20
#: Words at once in a task's counting.
HELD_WORDS = 2_000_000
#: Bytes of text of a chunk, which asks for its pairs and words together; a longer text is a chunk of its own.
CHUNK = 32 << 20
#: Pairs are counted, and texts judged, in so many parts one after the other: what is shuffled at once takes disk.
ROUNDS = 2
#: Different pairs of a chunk that are judged at once.
SLICE = 1 << 18
#: Keys of a bucket at most, about; there are 2**BUCKET_BITS buckets at least.
BUCKET_KEYS, BUCKET_BITS = 1_000_000, 5
#: Rows of the tables of pairs and words that a task packs together: the more, the shorter the steps between their keys.
PACKED_ROWS = 1 << 19
#: Rows that the final logistic curve is fitted to: about so many, chosen by a hash of key and text (twice as many at most, where rows repeat), and this share of them at most.
CURVE_ROWS, CURVE_SHARE = 20_000, 0.25
#: Score from which a text is called toxic.
THRESHOLD = 0.3
_TELLING = 3

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Counts of pairs and of words, by class: of a pair's continuations (n), of a context's (n) and of words after it (after), of words before a word (types).
#: The second half holds what of these only the drawn rows have taught.
_PAIR = ["n0", "n1", "own_n0", "own_n1"]
_WORD = [f"{own}{name}{c}" for own in ("", "own_") for name in ("n", "after", "types") for c in (0, 1)]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, digits and non-ASCII, A-Z lower-cased) and each text's first word (n + 1)."""
    starts, ends = spans(_INSIDE[data], at)
    return (span_hashes(LOWER[data], starts, ends) >> U64(64 - WORD_BITS)).astype(np.int64), np.searchsorted(starts, at)


def contexts(words: np.ndarray, first: np.ndarray, back: int = 1) -> np.ndarray:
    """The word that comes back words before each word; 0 where a text begins later."""
    before = np.zeros_like(words)
    before[back:] = words[: max(0, len(words) - back)]
    starts = first[:-1]
    for k in range(back):
        before[starts[np.diff(first) > k] + k] = 0
    return before


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of pairs of words."""
    return mix(mix(before.astype(U64) + U64(0x9E3779B97F4A7C15)) + words.astype(U64)) >> U64(64 - KEY_BITS)


def word_keys(words: np.ndarray) -> np.ndarray:
    """Keys of words, one to one, spread over all buckets."""
    return mix(words.astype(U64)) >> U64(64 - KEY_BITS)


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length of whole numbers, by planes of bytes, each compressed."""
    codec, n = pa.Codec("zstd"), len(columns[0])
    widths = [(int(c.max()).bit_length() + 7) // 8 if n else 0 for c in columns]
    planes = [codec.compress(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, k]), asbytes=True) for c, w in zip(columns, widths, strict=True) for k in range(w)]
    return b"".join([np.array([n, len(columns), *widths, *map(len, planes)], "<u4").tobytes(), *planes])


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns that pack has packed."""
    codec = pa.Codec("zstd")
    n, k = np.frombuffer(blob, "<u4", 2).tolist()
    widths = np.frombuffer(blob, "<u4", k, 8).tolist()
    lengths = np.frombuffer(blob, "<u4", sum(widths), 8 + 4 * k).tolist()
    at, planes = 8 + 4 * (k + len(lengths)), iter(lengths)
    columns = []
    for w in widths:
        bytes_ = np.zeros((n, 8), np.uint8)
        for i in range(w):
            size = next(planes)
            bytes_[:, i] = np.frombuffer(codec.decompress(blob[at : at + size], n), np.uint8)
            at += size
        columns.append(bytes_.view("<u8").ravel())
    return columns


def _by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets of ascending keys, by their upper bits, and where they lie."""
    cuts = np.searchsorted(keys >> U64(KEY_BITS - bits), np.arange((1 << bits) + 1, dtype=U64))
    yield from ((k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a)


def count_pairs(docs: DataFrame, held: list[str] | None = None) -> DataFrame:
    """Counts (_PAIR) of each pair of words in rows (text, toxic 0/1, drawn 0/1), all of them counted; u and w: the words' hashes. held: as in materialize."""
    schema = T.StructType([T.StructField("pair", T.LongType()), T.StructField("low", T.IntegerType()), T.StructField("t", T.IntegerType())])
    half = WORD_BITS - 32

    def seen(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        got: list[np.ndarray] = []

        def distinct() -> pa.RecordBatch:
            pair, rest = np.concatenate(got, axis=1)
            got.clear()
            order = np.lexsort((rest, pair))
            pair, rest = pair[order], rest[order]
            new = np.append(True, (pair[1:] != pair[:-1]) | (rest[1:] != rest[:-1]))
            pair, rest = pair[new], rest[new]
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array((rest >> 32).astype(np.int32)), pa.array(rest.astype(np.int32))], names=schema.names)

        for batch in batches:
            toxic, drawn = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("toxic", "drawn"))
            for i, j, data, at in blocks(batch.column("text")):
                words, first = word_hashes(data, at)
                if len(words):
                    # 48 bits of each word of the pair; 30 of the word before it, the class and whether the row is drawn.
                    before = contexts(words, first, 2) & ((1 << BEFORE_BITS) - 1)
                    rest = words << 32 | before << 2 | np.repeat(toxic[i:j] << 1 | drawn[i:j], np.diff(first))
                    first_word = contexts(words, first)
                    mine = (first_word + words) % ROUNDS == part
                    got.append(np.stack([first_word << half | words >> 32, rest])[:, mine])
                    if sum(h.shape[1] for h in got) > HELD_WORDS:
                        yield distinct()
        if got:
            yield distinct()

    # Dealt by pair once; removing repeats and counting both find their rows together then.
    rows = docs.select("text", F.col("toxic").cast("int").alias("toxic"), F.col("drawn").cast("int").alias("drawn"))
    of = [F.col("t").bitwiseAND(1) == c for c in (0, 1)]
    counts = [*(F.count_if(x).alias(f"n{c}") for c, x in enumerate(of)), *(F.count_if(x & (F.col("drawn") == 1)).alias(f"own_n{c}") for c, x in enumerate(of))]
    parts = []
    for part in range(ROUNDS):
        dealt = rows.mapInArrow(lambda batches, part=part: seen(batches, part), schema).repartition("pair", "low")
        once = dealt.groupBy("pair", "low", F.shiftright("t", 1).alias("t")).agg(F.min(F.col("t").bitwiseAND(1)).alias("drawn"))
        parts.append(materialize(once.groupBy("pair", "low").agg(*counts), "toxic-pairs", drop_shuffles=True, held=held))
    w = F.shiftleft(F.col("pair").bitwiseAND((1 << half) - 1), 32).bitwiseOR(F.col("low").cast("long").bitwiseAND((1 << 32) - 1))
    return reduce(DataFrame.unionAll, parts).select(F.shiftrightunsigned("pair", half).alias("u"), w.alias("w"), *_PAIR)


def count_words(pairs: DataFrame, held: list[str] | None = None) -> DataFrame:
    """Counts (_WORD) of each word of count_pairs, as the first and as the second of its pairs. held: as in materialize."""
    there = {f"{own}is{c}": (F.col(f"n{c}") > 0) if not own else (F.col(f"n{c}") > 0) & (F.col(f"own_n{c}") == F.col(f"n{c}")) for own in ("", "own_") for c in (0, 1)}
    parts = []
    for role in ("u", "w"):
        cols = []
        for name in _WORD:
            own, c = "own_" if name.startswith("own_") else "", name[-1]
            as_first, count = "types" not in name, F.col(name) if name in _PAIR else there[f"{own}is{c}"].cast("long")
            cols.append((count if as_first == (role == "u") else F.lit(0).cast("long")).alias(name))
        parts.append(pairs.select(F.col(role).alias("word"), *cols))
    return materialize(parts[0].unionAll(parts[1]).groupBy("word").agg(*(F.sum(c).alias(c) for c in _WORD)), "toxic-words", drop_shuffles=True, held=held)


def _cut(once: int, twice: int) -> float:
    """Absolute discount from the numbers of things seen once and twice."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


@dataclass(frozen=True)
class Totals:
    """What the models need besides counts of single pairs and words; by class but for the last two: discounts of
    pairs and of words, pairs, different words; words by classes they occur in, different words of both."""

    pair_cut: tuple[float, float]
    word_cut: tuple[float, float]
    types: tuple[float, float]
    words: tuple[float, float]
    shared: float
    vocabulary: float

    def ratios(self, n: list[np.ndarray], context: list[np.ndarray], word: list[np.ndarray]) -> np.ndarray:
        """log P(word | context, toxic) - log P(word | context, ordinary): of counts by class of pairs (n0, n1), of their first
        words (n0, n1, after0, after1) and of their second words (types0, types1)."""
        base = ((word[0] > 0) + (word[1] > 0).astype(float) + 0.5) / (self.shared + 0.5 * (self.vocabulary + UNSEEN))
        p = []
        for c in (0, 1):
            own = np.maximum(word[c] - self.word_cut[c], 0) / self.types[c] + self.word_cut[c] * self.words[c] / self.types[c] * base
            known = context[c] > 0
            back = np.where(known, np.maximum(self.pair_cut[c] * context[2 + c], 1e-6) / np.maximum(context[c], 1), 1.0)
            p.append(np.maximum(n[c] - self.pair_cut[c], 0) / np.maximum(context[c], 1) + back * own)
        return np.log(p[1]) - np.log(p[0])


def totals(pairs: DataFrame, words: DataFrame, rest: bool) -> Totals | None:
    """Totals over all rows, or over those that are not drawn. None unless both classes have words."""

    def count(name: str):
        return F.col(name) - F.col(f"own_{name}") if rest else F.col(name)

    p = pairs.agg(*(F.count_if(count(f"n{c}") == k).alias(f"p{c}{k}") for c in (0, 1) for k in (1, 2))).first()
    types = [count(f"types{c}") for c in (0, 1)]
    w = words.agg(
        *(F.count_if(types[c] == k).alias(f"w{c}{k}") for c in (0, 1) for k in (1, 2)),
        *(F.coalesce(F.sum(types[c]), F.lit(0)).alias(f"sum{c}") for c in (0, 1)),
        *(F.count_if(types[c] > 0).alias(f"some{c}") for c in (0, 1)),
        F.count_if((types[0] > 0) | (types[1] > 0)).alias("either"),
    ).first()
    if not w.some0 or not w.some1:
        return None
    return Totals((_cut(p.p01, p.p02), _cut(p.p11, p.p12)), (_cut(w.w01, w.w02), _cut(w.w11, w.w12)), (w.sum0, w.sum1), (w.some0, w.some1), w.some0 + w.some1, w.either)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows in order, cut after limit bytes of their last column, whatever the batches."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        i, base = 0, 0
        while i < len(ends):
            j = min(len(ends), int(np.searchsorted(ends, base + limit - size)) + 1)
            held.append(batch.slice(i, j - i))
            size, base, i = size + int(ends[j - 1]) - base, int(ends[j - 1]), j
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _read(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a chunk's texts and each text's first word."""
    words, firsts, n = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
    for part in texts.chunks:
        for _, _, data, at in blocks(part):
            got, first = word_hashes(data, at)
            words.append(got)
            firsts.append(first[1:] + n)
            n += len(got)
    return np.concatenate(words), np.concatenate(firsts)


def _name(texts: pa.ChunkedArray) -> int:
    """A chunk's name: a hash of its texts and where they end."""
    h = blake2b(digest_size=8)
    for part in texts.chunks:
        for _, _, data, at in blocks(part):
            h.update(np.diff(at).tobytes())
            h.update(data)
    return int.from_bytes(h.digest(), "little", signed=True)


_MAIL = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("body", T.BinaryType())])


def _mail(chunk: int | None, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, body = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], names=_MAIL.names)


def _steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, which are short."""
    return np.diff(keys, prepend=U64(0))


def by_bucket(pairs: DataFrame, words: DataFrame, held: list[str] | None = None, limit: int = PACKED_ROWS) -> tuple[DataFrame, int]:
    """The counts of pairs (kind 0) and words (kind 1) as mail to the buckets of their keys, and the bits of these buckets. held: as in materialize."""
    bits = max(BUCKET_BITS, ((pairs.count() + words.count()) // BUCKET_KEYS).bit_length())

    def packed(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
        got, n = [], 0

        def mail() -> pa.RecordBatch:
            cols = [np.concatenate([batch.column(k).to_numpy() for batch in got]) for k in range(got[0].num_columns)]
            got.clear()
            keys, counts = (word_keys(cols[0]), cols[1:]) if kind else (pair_keys(cols[0], cols[1]), cols[2:])
            order = np.argsort(keys)
            keys = keys[order]
            return _mail(None, [(b, kind, pack([_steps(keys[at]), *(c[order[at]] for c in counts)])) for b, at in _by_bucket(keys, bits)])

        for batch in batches:
            got.append(batch)
            n += batch.num_rows
            if n >= limit:
                yield mail()
                n = 0
        if n:
            yield mail()

    parts = [table.mapInArrow(lambda batches, kind=kind: packed(batches, kind), _MAIL) for kind, table in enumerate((pairs.select("u", "w", *_PAIR), words.select("word", *_WORD)))]
    return materialize(parts[0].unionAll(parts[1]), "toxic-model", held=held), bits


def answers(rows: DataFrame, model: DataFrame, bits: int, chunk: int, held: list[str]) -> DataFrame:
    """For every chunk of rows, bucket and kind: the counts of the chunk's keys by the model of by_bucket, in ascending order of these; zeros where none are known. held: as in materialize."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, chunk):
            found, first = _read(table.column(table.num_columns - 1))
            before = contexts(found, first)
            keys = np.unique(pair_keys(before, found)), np.unique(word_keys(np.append(found, 0)))
            del found, before
            yield _mail(_name(table.column(table.num_columns - 1)), [(b, kind, pack([_steps(k[at])])) for kind, k in enumerate(keys) for b, at in _by_bucket(k, bits)])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, own = None, [], None
        for batch in batches:
            for name, bucket, kind, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (bucket, kind) != now:
                    now, parts, own = (bucket, kind), [], None
                if name is None:
                    steps, *counts = unpack(body)
                    parts.append((np.cumsum(steps, dtype=U64), [c.astype(np.uint32) if c.max(initial=0) < 1 << 32 else c for c in counts]))
                    continue
                if own is None and parts:
                    keys = np.concatenate([k for k, _ in parts])
                    order = np.argsort(keys)
                    own, parts = (keys[order], [np.concatenate(c)[order] for c in zip(*(c for _, c in parts), strict=True)]), []
                wanted = np.cumsum(unpack(body)[0], dtype=U64)
                if own is None:
                    counts = [np.zeros(len(wanted), U64)] * len(_WORD if kind else _PAIR)
                else:
                    at = np.minimum(np.searchsorted(own[0], wanted), len(own[0]) - 1)
                    known = own[0][at] == wanted
                    counts = [np.where(known, c[at], 0) for c in own[1]]
                yield _mail(name, [(bucket, kind, pack(counts))])

    mail = rows.mapInArrow(asked, _MAIL).unionAll(model).repartition("bucket").sortWithinPartitions("bucket", "kind", F.col("chunk").asc_nulls_first())
    return materialize(mail.mapInArrow(answered, _MAIL), "toxic-answers", drop_shuffles=True, held=held)


_NAMES = ["ratio", "top", "telling"]


def _judged(llr: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of each text: mean over words, the largest, and the mean of the largest three."""
    n = np.diff(first)
    total = np.append(0, np.cumsum(llr))
    mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
    top, telling = np.zeros(len(n)), np.zeros(len(n))
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            most = llr[a:b] if b - a <= _TELLING else np.partition(llr[a:b], b - a - _TELLING)[-_TELLING:]
            top[k], telling[k] = most.max(), most.mean()
    return [mean, top, telling]


def features(rows: DataFrame, pairs: DataFrame, words: DataFrame, full: Totals, rest: Totals | None, chunk: int = CHUNK) -> DataFrame:
    """judge() by the tables of count_pairs and count_words, which stay."""
    held: list[str] = []
    out = judge(rows, *by_bucket(pairs, words, held), full, rest, chunk)
    discard(rows.sparkSession, held)
    return out


def judge(rows: DataFrame, model: DataFrame, bits: int, full: Totals, rest: Totals | None, chunk: int = CHUNK) -> DataFrame:
    """rows (their last column: the text) without the text, with _NAMES by the counts of all labelled rows, the same as
    rest_ by those that are not drawn (by all, without rest), and n_words. model, bits: of by_bucket.

    Rows are read twice and must come in the same order both times; that they don't is an error.
    """
    held: list[str] = []
    got = answers(rows, model, bits, chunk, held)
    kept = T.StructType(rows.schema[:-1])
    schema = T.StructType([*kept, *(T.StructField(x + c, T.DoubleType()) for x in ("", "rest_") for c in _NAMES), T.StructField("n_words", T.LongType())])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, chunk):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            yield _mail(_name(table.column(table.num_columns - 1)), [(-1, 2, sink.getvalue().to_pybytes())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mail = None, {}
        for batch in batches:
            for name, bucket, kind, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if name != now:
                    now, mail = name, {}
                if kind < 2:
                    mail[kind, bucket] = body
                    continue
                table = pa.ipc.open_stream(body).read_all()
                found, first = _read(table.column(table.num_columns - 1))
                before = contexts(found, first)
                keys, pair = np.unique(pair_keys(before, found), return_inverse=True)
                # Each different pair is looked at once.
                some = np.zeros(len(keys), np.int64)
                some[pair] = np.arange(len(pair))
                before, found = before[some], found[some]
                known = np.unique(word_keys(np.append(found, 0)))
                counts = []
                for k, names in enumerate((_PAIR, _WORD)):
                    parts = [unpack(mail[at]) for at in sorted(mail) if at[0] == k]
                    counts.append({c: np.concatenate([p[i] for p in parts] or [np.zeros(0, U64)]).astype(np.float64 if k else np.uint32) for i, c in enumerate(names)})
                    del parts
                if len(counts[0]["n0"]) != len(keys) or len(counts[1]["n0"]) != len(known):
                    raise RuntimeError("rows came in another order when they were read again: write them to a table first")
                own = [{c: x[c] for c in x if not c.startswith("own_")} for x in counts]
                less = [{c: x[c] - x[f"own_{c}"] for c in y} for x, y in zip(counts, own, strict=True)]
                llr = np.zeros((2, len(keys)))
                for a in range(0, len(keys), SLICE):
                    at = slice(a, a + SLICE)
                    u, w = (np.searchsorted(known, word_keys(x[at])) for x in (before, found))
                    for k, (by, (n, word)) in enumerate(((full, own), (rest, less)) if rest else ((full, own), (full, own))):
                        llr[k, at] = by.ratios([n[f"n{c}"][at].astype(np.float64) for c in (0, 1)], [word[f"{x}{c}"][u] for x in ("n", "after") for c in (0, 1)], [word[f"types{c}"][w] for c in (0, 1)])
                out = [x for k in (0, 1) for x in _judged(llr[k][pair], first)]
                columns = [*(table.column(c).combine_chunks() for c in kept.names), *map(pa.array, out), pa.array(np.diff(first), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    both = got.unionAll(rows.mapInArrow(sent, _MAIL)).repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket")
    out = materialize(both.mapInArrow(scored, schema), "toxic-features", drop_shuffles=True)
    discard(rows.sparkSession, held)
    return out


_INPUTS = ("1", "ratio", "ratio * sqrt(n_words)", "top", "telling", "ln(n_words + 1)", "telling * ln(n_words + 1)")


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held: int = 2) -> DataFrame:
    """Per row: key, held_out, score (0 to 1), predicted (score >= THRESHOLD).

    Held-out rows (crc32 of the key as text, modulo folds, is held) teach nothing. The models that judge learn from all
    other labelled rows. How much the likelihood ratios are worth the logistic curve learns from about CURVE_ROWS of
    these rows, judged by models of all the others (by the final models where those lack a class). Null and empty texts
    are scored as texts without words. A repeated row teaches as often as it occurs; keys labelled twice count once for
    each label. Without toxic or ordinary rows every score is the toxic share of the labels (0 without any).
    """
    fold = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)), F.lit(-1))
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"), fold.alias("fold"))
    marks = labels.filter(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("toxic"))
    # Labels that must not teach are dropped before the join, and so are unlabelled texts by it.
    marks = marks.filter(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)) != held)
    # Few labels go to the texts; beyond that bound both sides are shuffled by key.
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = rows.join(F.broadcast(marks) if few else marks, key)
    share = min(CURVE_SHARE, CURVE_ROWS / max(known.count(), 1))
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), "text"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows, known = rows.withColumn("drawn", drawn), known.withColumn("drawn", drawn)
    counted: list[str] = []
    pairs = count_pairs(known, counted)
    words = count_words(pairs, counted)
    full = totals(pairs, words, rest=False)
    if full is None:
        discard(docs.sparkSession, counted)
        base = marks.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        scored = rows.withColumn("score", F.lit(float(base)))
    else:
        rest, part = totals(pairs, words, rest=True), F.pmod(F.xxhash64(F.lit("part"), F.col(key).cast("string"), "text"), F.lit(ROUNDS))
        packed: list[str] = []
        model, bits = by_bucket(pairs, words, packed)
        discard(docs.sparkSession, counted)
        judged = reduce(DataFrame.unionAll, [judge(rows.filter(part == k).select(key, "fold", "drawn", "text"), model, bits, full, rest) for k in range(ROUNDS)])
        discard(docs.sparkSession, packed)
        inputs = [F.expr(e.replace("ratio", "rest_ratio").replace("top", "rest_top").replace("telling", "rest_telling")).cast("double").alias(f"x{k}") for k, e in enumerate(_INPUTS)]
        taught = judged.filter("drawn").join(F.broadcast(marks) if few else marks, key)
        got = taught.limit(2 * CURVE_ROWS).select("toxic", *inputs).toPandas()
        x, y = got[[f"x{k}" for k in range(len(_INPUTS))]].to_numpy(), got["toxic"].to_numpy(float)
        mean, std = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(_INPUTS)), np.ones(len(_INPUTS)))
        mean[0], std = 0.0, np.where(std > 0, std, 1.0)
        w = fit_curve((x - mean) / std, y) / std
        w[0] -= float(mean @ w)
        z = sum((F.lit(float(a)) * F.expr(e) for a, e in zip(w, _INPUTS, strict=True)), F.lit(0.0))
        scored = judged.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select(key, (F.col("fold") == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
