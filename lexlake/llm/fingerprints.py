"""Winnowing fingerprints of documents, in DataFrame functions only.

A text's units are the same whatever its length: pieces of at most 4 characters of its words, lower-cased and cut from a word's
beginning on (anew where it goes from ASCII to others), and single characters in scripts that are written without spaces. Every run of K units has a
rolling (Karp-Rabin) hash; of every W such hashes in a row the least is chosen, of equal ones the rightmost; chosen
hashes are kept with their positions. At the beginning there are shorter windows too, from one hash on. So any two texts that share
K + W - 1 units in a row share a chosen hash, texts that begin alike share one from K units on, and a match shorter than
K units is never reported.

A rolling hash gives the next run's value from the last one's, one after the other. Here the same values come for all runs at once
by doubling: with h(n, i) the hash of n units from i on, h(a + b, i) = h(a, i) * B^b + h(b, i + a) modulo a prime. The least
values of windows come in the same way. Both are additions of shifted arrays, so nothing is sliced or hashed anew per run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Units in a hashed run, and hashes of which one is chosen.
GRAM, WINDOW = 4, 8
#: Rows of a bucket of the order that links each document to the next, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 256, 65_536

#: Hashes are polynomials of this base modulo this prime.
_PRIME, _BASE = (1 << 31) - 1, 1_103_515_245
#: White space, and blocks of scripts that are written without spaces (Thai to Tibetan, Myanmar, Khmer, kana, Han). Fixed values.
_WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_ALONE = r"\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
UNIT = rf"[\x21-\x7E]{{1,4}}|[{_ALONE}]|[^{_WHITE}{_ALONE}]{{1,4}}"
#: Bits below a hash that hold its position; texts of more units than that are beyond what a row may hold.
_PLACES = 26
_FIRST = -(2**63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def units(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(0))


def _runs(values: Column, n: int, join: Callable[[Column, Column, int], Column], body: Callable[[Column, Column], Column]) -> Column:
    """body of the values of all runs of n, and of those of their first halves: join(x, y, b) makes that of a run from those of its parts, the last of b."""
    sizes, todo = set(), [n]
    while todo:
        if (s := todo.pop()) > 1 and s not in sizes:
            sizes.add(s)
            todo += [s - s // 2, s // 2]

    def bind(done: dict[int, Column], left: list[int]) -> Column:
        if not left:
            return body(done[n], done[n - n // 2])
        s = left[0]
        a, b = s - s // 2, s // 2
        count = F.greatest(F.size(values) - (s - 1), F.lit(0))
        both = F.zip_with(F.slice(done[a], F.lit(1), count), F.slice(done[b], F.lit(a + 1), count), lambda x, y: join(x, y, b))
        return let(both, lambda c: bind({**done, s: c}, left[1:]))

    return bind({1: values}, sorted(sizes))


def _rolled(x: Column, y: Column, b: int) -> Column:
    return (x * F.lit(pow(_BASE, b, _PRIME)) + y) % F.lit(_PRIME)


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """array<struct<hash, position>> in order of position; empty for a null text or one without units.

    Positions count units from 0. A text of fewer than gram units has one hash, of all of them. Hashes are compared by
    their rolling value; what is kept of one is that value and its first half's, 62 bits together.
    """
    last = F.lit((1 << _PLACES) - 1).cast("long")
    before = F.array_repeat(F.lit((1 << 63) - 1), window - 1)

    def chosen(whole: Column, half: Column) -> Column:
        # A value with its position below it: the least is the least hash, of equal ones the rightmost. First windows hang over the beginning, where all is less than what fills it up.
        marked = F.transform(whole, lambda h, i: F.shiftleft(h, _PLACES).bitwiseOR(last - i))
        place = lambda c: (last - c.bitwiseAND(last)).cast("int")
        kept = lambda c: let(place(c), lambda p: F.struct(F.shiftleft(F.get(whole, p), 31).bitwiseOR(F.get(half, p)).alias("hash"), p.alias("position")))
        return let(F.concat(before, marked), lambda m: _runs(m, window, lambda x, y, b: F.least(x, y), lambda least, _: F.transform(F.array_distinct(least), kept)))

    def of_units(u: Column) -> Column:
        values = F.transform(u, lambda c: F.xxhash64(c).bitwiseAND(F.lit(_PRIME)))
        one = F.array(F.struct(F.xxhash64(u).alias("hash"), F.lit(0).alias("position")))
        none = F.array().cast("array<struct<hash: bigint, position: int>>")
        return F.when(F.size(u) == 0, none).when(F.size(u) < gram, one).otherwise(let(values, lambda v: _runs(v, gram, _rolled, chosen)))

    return let(units(F.coalesce(text, F.lit(""))), of_units)


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: x["hash"]))


def digest(fingerprint: Column) -> Column:
    """One string for hashes and positions."""
    return F.sha2(F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", x["position"].cast("string"), F.hex(x["hash"]))), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 for two empty ones."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def fingerprints(docs: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs with a column fingerprint: see winnow. Rows and other columns stay as they are."""
    return docs.withColumn("fingerprint", winnow(F.col(text), gram, window))


def ordered_buckets(df: DataFrame, order: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """df with __bucket: ranges of about so many rows, ascending in the long column order, from its quantiles."""
    n = df.count()
    p = min(MOST_BUCKETS, max(1, n // rows))
    if p < 2:
        return df.withColumn("__bucket", F.lit(0))
    key = df.select(F.col(order).cast("double").alias("v"))
    bounds = sorted(set(key.approxQuantile("v", [i / p for i in range(1, p)], 1 / (4 * p))))
    spread = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="__v", outputCol="__b")
    return spread.transform(df.withColumn("__v", F.col(order).cast("double"))).withColumn("__bucket", F.col("__b").cast("int")).drop("__v", "__b")


def with_next(docs: DataFrame) -> DataFrame:
    """(id, o, text) with __bucket and, once more at the end of each bucket, the first row of the next (last: true).

    Next in descending order of o: a row's successor then is the row after it within its bucket.
    """
    rows = ordered_buckets(docs, "o")
    heads = rows.groupBy("__bucket").agg(F.max("o").alias("o"))
    # One row a bucket, so one task holds them at any size.
    order = W.orderBy(F.col("__bucket").desc())
    turn = W.orderBy(F.col("__bucket").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select("__bucket", F.coalesce(F.lead("o").over(order), F.first("o").over(turn)).alias("head"))
    first = docs.join(F.broadcast(heads), F.col("o") == F.col("head")).drop("head")
    return rows.withColumn("last", F.lit(False)).unionByName(first.withColumn("last", F.lit(True)))


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of texts and of their edited forms, compared.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next
    document's, in descending order of key, after the last the first. Per row: key, n_chars, edited_sha256,
    fingerprint, edited_fingerprint (digests), near_edited, near_next, and the fingerprint itself, with positions, as
    winnowed (see winnow). Texts are shuffled once, by ranges of the key. A null text counts as empty, a null key comes last; rows with equal keys follow each other by text.
    """
    clean = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)).alias("o"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Only texts are shuffled and sorted; fingerprints are made where they then lie.
    own = with_next(clean).repartition("__bucket").sortWithinPartitions("__bucket", "last", F.col("o").desc(), "text")
    own = own.withColumn("f", let(winnow(F.col("text"), gram, window), lambda f: F.struct(digest(f).alias("digest"), f.alias("marks"))))
    order = W.partitionBy("__bucket").orderBy("last", F.col("o").desc(), "text")
    linked = own.select("id", "last", "text", "f", F.lead("text").over(order).alias("next_text"), F.lead("f.marks").over(order).alias("next_marks")).filter(~F.col("last"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    compared = let(
        edited,
        lambda e: let(
            winnow(e, gram, window),
            lambda g: F.struct(F.sha2(e, 256).alias("edited_sha256"), digest(g).alias("edited_fingerprint"), likeness(hashes(F.col("f.marks")), hashes(g)).alias("near_edited")),
        ),
    )
    out = linked.select("id", F.char_length("text").cast("long").alias("n_chars"), F.col("f.digest").alias("fingerprint"), likeness(hashes(F.col("f.marks")), hashes(F.col("next_marks"))).alias("near_next"), F.col("f.marks").alias("winnowed"), compared.alias("c"))
    return out.select(F.col("id").alias(key), "n_chars", "c.edited_sha256", "fingerprint", "c.edited_fingerprint", "c.near_edited", "near_next", "winnowed")
