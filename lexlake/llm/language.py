"""Language identification by bit-sliced Bloom filters over character n-grams.

Each language has a Bloom filter of its commonest n-grams, all of the same size and hash functions, stored slice by
slice: cell i holds a bit mask of the languages whose filter has bit i. The conjunction of an n-gram's cells is
the mask of all languages that contain it. A text's masks are counted by language; a language's count is freed of
the hits that its filter's fill would give by chance, and the language with most hits left is the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm.pretokens import LETTER, classes, lowering
from lexlake.llm.scan import SECTION, U64, blocks, counted, mix

#: Lengths of n-grams, in code points; every run of other characters than letters counts as one space.
ORDERS = (2, 3, 4)
#: Labelled rows that are looked at: about so many, chosen by a hash of the key and language by language; of each language
#: about LEAST_ROWS at least, or all of its rows.
TRAIN_ROWS, LEAST_ROWS = 20_000, 100
#: N-grams in a language's filter: all that make up this share of its n-grams of that length at least. So there are
#: 1 / LEAST_SHARE of them at most, whatever the corpus.
LEAST_SHARE = 1e-4
#: Cells of the filters (a power of two) and cells that an n-gram sets.
CELLS, HASHES = 1 << 18, 3
UNKNOWN = "und"


def grams(cps: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Orders with hashes of n-grams that have a letter, and the text that each belongs to. cps: code points, at: offsets.

    Texts are padded with a space at both ends. A long text's n-grams come in sections.
    """
    n = len(at) - 1
    letter = classes()[cps] == LETTER
    low = lowering()[0][cps]
    owner = np.repeat(np.arange(n), np.diff(at))
    # A character stays if it is a letter or the first one after a letter (as a space); one space leads each text.
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    kept = np.flatnonzero(keep)
    value, whose = np.where(letter[kept], low[kept], 0x20).astype(np.uint32), owner[kept]
    lead = np.searchsorted(whose, np.arange(n))
    value, whose = np.insert(value, lead, np.uint32(0x20)), np.insert(whose, lead, np.arange(n))
    tail = np.searchsorted(whose, np.arange(n), "right")
    ends_bare = value[tail - 1] != 0x20
    value, whose = np.insert(value, tail[ends_bare], np.uint32(0x20)), np.insert(whose, tail[ends_bare], np.arange(n)[ends_bare])
    for order in ORDERS:
        for a in range(0, len(value) - order + 1, SECTION):
            own, owns = value[a : a + SECTION + order - 1].astype(U64), whose[a : a + SECTION + order - 1]
            m = len(own) - order + 1
            h = own[:m].copy()
            for k in range(1, order):
                h = h << U64(16) ^ h >> U64(47) ^ own[k : k + m]
            inside = owns[:m] == owns[order - 1 :]
            yield order, mix(h[inside] + U64(order)), owns[:m][inside]


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows as code points with offsets."""
    for i, j, data, at in blocks(column):
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))[at]
        yield i, j, np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), chars


@dataclass(frozen=True)
class LanguageFilters:
    """languages; masks (words of 64 languages, cells): the slices; fallback: the language of texts without a hit."""

    languages: list[str]
    masks: np.ndarray
    fallback: str

    @cached_property
    def chance(self) -> np.ndarray:
        """Probability for each language that its filter has an n-gram by chance."""
        bits = np.array([np.count_nonzero(self.masks[k // 64] >> U64(k % 64) & U64(1)) for k in range(len(self.languages))])
        return (bits / self.masks.shape[1]) ** HASHES

    def containing(self, h: np.ndarray) -> np.ndarray:
        """Masks (words, n-grams) of the languages that contain each n-gram."""
        found = None
        for k in range(HASHES):
            cells = self.masks[:, (h >> U64(20 * k)).astype(np.int64) & (self.masks.shape[1] - 1)]
            found = cells if found is None else found & cells
        return found


def build_filters(top: dict[str, np.ndarray], fallback: str, cells: int = CELLS) -> LanguageFilters:
    """Filters of the given n-gram hashes of each language."""
    names = sorted(top)
    masks = np.zeros((max(1, -(-len(names) // 64)), cells), U64)
    for k, name in enumerate(names):
        for i in range(HASHES):
            masks[k // 64, (top[name] >> U64(20 * i)).astype(np.int64) & (cells - 1)] |= U64(1 << k % 64)
    return LanguageFilters(names, masks, fallback)


def rows_each(counts: list[int], rows: int) -> int:
    """Most rows of a language, so that all languages, rarer ones whole, have rows together; LEAST_ROWS at least."""
    left, each = rows, 0
    for k, n in enumerate(sorted(counts)):
        each = left // (len(counts) - k)
        if n > each:
            break
        left, each = left - n, n
    return max(each, LEAST_ROWS)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> LanguageFilters | None:
    """Filters from rows with a language: about rows of them, by a hash of the key, of each language. None without such rows.

    N-grams are counted in all of these rows; what comes to the driver is 1 / LEAST_SHARE n-grams a language and order at most.
    """
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(1 << 30))
    known = docs.filter(F.col(lang).isNotNull()).select(draw.alias("draw"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    languages = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("first")).collect()
    if not languages:
        return None
    each = rows_each([r.n for r in languages], rows)
    # One row of a language is drawn at least.
    last = [(r.lang, max(r.first, int(min(1.0, each / r.n) * (1 << 30)) - 1)) for r in languages]
    part = known.join(F.broadcast(docs.sparkSession.createDataFrame(last, "lang string, last long")), "lang").filter("draw <= last")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for i, j, cps, at in _texts(batch.column("text")):
                own = langs.slice(i, j - i).dictionary_encode()
                code = own.indices.to_numpy()
                for order, h, whose in grams(cps, at):
                    for c, name in enumerate(own.dictionary.to_pylist()):
                        found, times = np.unique(h[code[whose] == c], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(np.full(len(found), order, np.int32)), pa.array(found.view(np.int64)), pa.array(times)], names=schema.names)

    counts = part.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "k", "h").agg(F.sum("n").alias("n"))
    shared = counts.groupBy("lang", "k").agg(F.sum("n").alias("all"))
    best = counts.join(F.broadcast(shared), ["lang", "k"]).filter(F.col("n") >= F.lit(LEAST_SHARE) * F.col("all")).select("lang", "h").collect()
    common = min(languages, key=lambda r: (-r.n, r.lang)).lang
    top: dict[str, list[int]] = {}
    for r in best:
        top.setdefault(r.lang, []).append(r.h)
    return build_filters({k: np.array(v, np.int64).view(U64) for k, v in top.items()} or {common: np.zeros(0, U64)}, common)


FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("hit_rate", T.DoubleType())])


def judge(own: LanguageFilters | None, column: pa.Array) -> pa.StructArray:
    """FOUND of each text, by the filters."""
    names, score, rate = [], [np.zeros(0)], [np.zeros(0)]
    for i, j, cps, at in _texts(column):
        n = j - i
        letters = counted(classes()[cps] == LETTER, at) > 0
        if own is None:
            names += [UNKNOWN] * n
            score.append(np.zeros(n))
            rate.append(np.zeros(n))
            continue
        total, hits = np.zeros(n), np.zeros((len(own.languages), n))
        for _, h, whose in grams(cps, at):
            masks = own.containing(h)
            edge = np.searchsorted(whose, np.arange(n + 1))
            total += np.diff(edge)
            for k in range(len(own.languages)):
                hits[k] += counted((masks[k // 64] >> U64(k % 64) & U64(1)).view(np.int64), edge)
        chance = own.chance[:, None]
        real = np.maximum(hits - total * chance, 0) / np.maximum(1 - chance, 1e-9)
        best, every, most = real.argmax(0), real.sum(0), real.max(0)
        score.append(np.where(letters & (every > 0), most / np.maximum(every, 1e-300), 0.0))
        rate.append(np.where(letters & (total > 0), np.minimum(most / np.maximum(total, 1), 1.0), 0.0))
        named = (own.languages[b] if e > 0 else own.fallback for b, e in zip(best.tolist(), every.tolist(), strict=True))
        names += [x if c else UNKNOWN for x, c in zip(named, letters.tolist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(rate))], names=FOUND.fieldNames())


def language_of(spark: SparkSession, filters: LanguageFilters | None) -> Callable[[Column], Column]:
    """A function of a text column: struct of lang_pred, score (the language's share of all languages' hits) and hit_rate
    (of n-grams, in that language).

    UNKNOWN with score 0 for a text that is null or has no letter, and without filters; the filters' fallback with
    score 0 where no language has a hit. Ties go to the first name. Only the text goes to Python; no shuffle.
    """
    shared = spark.sparkContext.broadcast(filters)

    def found(texts: pa.Array) -> pa.Array:
        return judge(shared.value, texts)

    # Marked so that a filter on the result is not moved before it and computed once more.
    judged = F.arrow_udf(found, FOUND).asNondeterministic()
    return lambda text: judged(text.cast("string"))


def predict_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, held: int = 1) -> DataFrame:
    """Per row: key, held_out (crc32 of the key as text, modulo folds, is held), lang_pred, score, hit_rate.

    Held-out rows teach nothing. Rows stay as they are, repeated or not, and a repeated one teaches as often as it
    occurs; a null key is never held out. See language_of for null and empty texts; an empty table gives no rows.
    Other columns, whatever their names, are not read.
    """
    out = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds)) == held, F.lit(False))
    filters = train(docs.filter(~out), key, text, lang)
    found = docs.select(F.col(key), out.alias("held_out"), language_of(docs.sparkSession, filters)(F.col(text)).alias("found"))
    return found.select(F.col(key), "held_out", "found.*")
