"""Exact Jaccard join of documents on word shingles, by token-combination prefixes.

A document is the set of its 64-bit shingle hashes. All sets are ordered alike: rare shingles by hash, then
frequent ones. If x and y are alike enough, x lacks at most t = |x| - ceil(threshold * |x|) of its shingles in y. So
with t + 1 rare shingles as a prefix each, the two prefixes share one. Frequent shingles would make long lists of that
kind; for them the prefix is extended and pairs are indexed: they are dealt to GROUPS groups by hash, and a prefix
with p_g frequent shingles in group g counts as sum(max(0, p_g - 1)), since unless a pair of one group is shared each
group holds at most one common shingle. Sets too small to be extended so far are compared with each other on single
shingles, in a name space of their own. Any choice of frequent shingles gives the same links; it only sets the cost.

Equal sets are one node. Documents with a signature in common are first compared with about HUBS of them, which covers small
groups whole; components of the links found so far then spare comparisons within them, and what is left between
components in larger groups is compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexlake.llm.components import components
from lexlake.llm.scan import U64, blocks, mix, span_hashes, words
from lexlake.storage import BROADCAST_ROWS, materialize

WORDS = 5
#: Likeness of linked documents, in hundredths.
PERCENT = 80
#: Frequent shingles: at most so many, the commonest, of at least so many documents.
MOST_FREQUENT, LEAST_DOCS = 1 << 16, 64
#: A task reports shingles that it sees in so many of about so many shingles' worth of documents.
LOCAL_DOCS, LOCAL_SHINGLES = 4, 2_000_000
GROUPS = 16
#: Pairs with a set below SMALL use single shingles; (GROUPS + 1) / 0.8 is the least that can be extended.
SMALL = 32
#: Documents of a signature that all others are compared with first: about so many, chosen by a hash.
HUBS = 8
#: Sets of a signature that a task compares with as many others; larger groups are cut into blocks of about so many.
BLOCK_SETS = 512
#: Signatures whose counts go to all tasks: the commonest, at most so many. Bits of the set that tells shared signatures.
MOST_HOT, SHARED_BITS = 1 << 16, 1 << 27
_SMALL_SPACE = U64(0xA24BAED4963EE407)


def shingles(data: np.ndarray, at: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets of the texts: sorted hashes one text after the other, their offsets (n + 1), and two 64-bit keys of each word sequence.

    Texts with fewer words than size have their whole sequence as the one element; those without words none.
    """
    h, _, _, first = words(data, at, lower=True)
    n_words = np.diff(first)
    keys = span_hashes(h, first[:-1], first[1:]), span_hashes(mix(h ^ U64(0x9FB21C651E98DF25)), first[:-1], first[1:])
    counts = np.maximum(n_words - size + 1, np.minimum(n_words, 1))
    where = np.append(0, np.cumsum(counts))
    m = len(h) - size + 1
    out = np.empty(where[-1], U64)
    full = np.flatnonzero(n_words >= size)
    if len(full):
        run = mix(h[:m])
        for k in range(1, size):
            run = mix(run + h[k : k + m])
        inside = np.ones(m, bool)
        for k in range(1, size):
            late = first[1:] - k
            inside[late[(late >= 0) & (late < m) & (n_words >= k)]] = False
        into = np.repeat(n_words >= size, counts)
        out[into] = run[inside]
    for k in np.flatnonzero((n_words > 0) & (n_words < size)):
        out[where[k]] = mix(keys[0][k : k + 1] + U64(1))[0]
    for a, b in zip(where[full].tolist(), where[full + 1].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[where[:-1][counts > 0]] = True
    return out[keep], np.append(0, np.cumsum(keep))[where], *keys


def most_missing(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Elements of a set of n that a set of the given likeness may lack."""
    return n - -(-percent * n // 100)


def signatures(sets: np.ndarray, at: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets and the set that each belongs to. frequent: sorted hashes."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    need = most_missing(n, percent) + 1
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, sets), len(frequent) - 1)
        rare = frequent[place] != sets
    else:
        rare = np.ones(len(sets), bool)
    before = np.append(0, np.cumsum(rare))
    n_rare = before[at[1:]] - before[at[:-1]]
    prefix = rare & (before[:-1] - before[at[:-1]][owner] < need[owner])
    large, small = n >= SMALL, n * percent < SMALL * 100
    out, of = [sets[prefix & large[owner]], mix(sets[prefix & small[owner]] + _SMALL_SPACE)], [owner[prefix & large[owner]], owner[prefix & small[owner]]]
    for k in np.flatnonzero((n > 0) & (n_rare < need)):
        own = sets[at[k] : at[k + 1]][~rare[at[k] : at[k + 1]]]
        more = int(need[k] - n_rare[k])
        if small[k]:
            out.append(mix(own[:more] + _SMALL_SPACE))
            of.append(np.full(len(out[-1]), k))
        if large[k]:
            group = (own % U64(GROUPS)).astype(np.int64)
            later = np.ones(len(own), bool)
            later[np.unique(group, return_index=True)[1]] = False
            end = int(np.searchsorted(np.cumsum(later), more)) + 1
            pairs = [mix(mix(own[i : i + 1]) + own[j : j + 1]) for g in range(GROUPS) for i, j in combinations(np.flatnonzero(group[:end] == g), 2)]
            out += pairs
            of.append(np.full(len(pairs), k))
    return np.concatenate(out), np.concatenate(of)


def _arrow(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _long(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _scan(docs: DataFrame) -> DataFrame:
    """A row of each document (kind 0: id, n, the two keys) and of locally frequent shingles (kind 1: n documents, hash as a)."""
    names = ["kind", "id", "n", "a", "b"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, known = [], 0, set()

        def common() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            c = np.diff(np.append(first, len(every)))
            h, c = every[first[c >= LOCAL_DOCS]], c[c >= LOCAL_DOCS]
            return _arrow([np.ones(len(h), np.int64), pa.nulls(len(h), pa.int64()), c.astype(np.int64), h.view(np.int64), np.zeros(len(h), np.int64)], names)

        for batch in batches:
            for i, j, data, at in blocks(batch.column("text")):
                sets, where, a, b = shingles(data, at)
                yield _arrow([np.zeros(j - i, np.int64), batch.column("id").slice(i, j - i), np.diff(where), a.view(np.int64), b.view(np.int64)], names)
                new = np.zeros(j - i, bool)
                for k, x in enumerate(a.tolist()):
                    if x not in known:
                        known.add(x)
                        new[k] = True
                held.append(sets[np.repeat(new, np.diff(where))])
                n_held += len(held[-1])
                if n_held > LOCAL_SHINGLES:
                    yield common()
                    n_held, known = 0, set()
        if held:
            yield common()

    return docs.mapInArrow(scan, _long(*names))


def _frequent(scanned: DataFrame) -> np.ndarray:
    """The frequent shingles: MOST_FREQUENT 64-bit numbers at most, whatever the input."""
    top = scanned.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_DOCS).orderBy(F.col("n").desc(), "a").limit(MOST_FREQUENT)
    return np.sort(np.array([r.a for r in top.select("a").collect()], np.int64).view(U64))


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs whose id is (left_semi) or isn't (left_anti) among ids: a broadcast while they are few, else a shuffle join."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_merge"), "id", how)


def _signed(docs: DataFrame, frequent: np.ndarray, percent: int, shared=None) -> DataFrame:
    """(sig, id, n): each document's signatures. shared: a broadcast bit set by sig % SHARED_BITS; only signatures in it then."""
    names = ["sig", "id", "n"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in blocks(batch.column("text")):
                sets, where, _, _ = shingles(data, at)
                sig, of = signatures(sets, where, frequent, percent)
                if shared is not None:
                    bit = sig & U64(SHARED_BITS - 1)
                    keep = (shared.value[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8) & 1).astype(bool)
                    sig, of = sig[keep], of[keep]
                yield _arrow([sig.view(np.int64), batch.column("id").slice(i, j - i).take(pa.array(of)), np.diff(where)[of]], names)

    return docs.filter("id IS NOT NULL").mapInArrow(signed, _long(*names))


def bit_set(values: DataFrame, column: str) -> np.ndarray:
    """SHARED_BITS bits as bytes: those of the column's values modulo their number are set. Of fixed size, whatever the table."""
    bit = F.col(column).bitwiseAND(SHARED_BITS - 1)
    rows = values.select(F.shiftright(bit, 15).alias("page"), bit.bitwiseAND((1 << 15) - 1).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((SHARED_BITS >> 15, 1 << 12), np.uint8)
    for r in rows:
        out[r.page] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _hot(counts: DataFrame) -> int:
    """Signatures of more sets than this are hot: MOST_HOT of them at most, so that any other has next to none of all rows."""
    top = [r.c for r in counts.filter(F.col("c") > 2 * BLOCK_SETS).select("c").orderBy(F.col("c").desc()).limit(MOST_HOT + 1).collect()]
    return top[-1] if len(top) > MOST_HOT else 2 * BLOCK_SETS


def _by_signature(rows: DataFrame, table: DataFrame, hot: int, how: str = "inner") -> DataFrame:
    """rows joined to a table of a few rows a signature, both with c. Hot signatures' part of it goes to the rows, where they
    lie; MOST_HOT bounds it. The rest is shuffled."""
    on = ["sig", "c"]
    return rows.filter(F.col("c") > hot).join(F.broadcast(table.filter(F.col("c") > hot)), on, how).unionByName(rows.filter(F.col("c") <= hot).join(table.filter(F.col("c") <= hot).hint("shuffle_merge"), on, how))


def _postings(docs: DataFrame, frequent: np.ndarray, percent: int) -> tuple[DataFrame, int]:
    """(sig, id, n, c, at): signatures that c > 1 sets have, each with its sets; at: the set's place from 0 to 1 in an order
    that is random but alike for all. And the count above which a signature is hot.

    No task sees all sets of a hot signature: they are counted by partial sums, and the counts go to them.
    """
    counts = _signed(docs, frequent, percent).groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id")).alias("same")).filter("c > 1")
    # Signatures of the same sets lead to the same pairs: one of them stands for all.
    counts = materialize(counts.select("sig", "c", F.xxhash64("same", "c").alias("alike")), "signatures")
    hot = _hot(counts)
    # Most signatures are of one set. A bit set leaves few of them to be shuffled; the join with the counts is exact.
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(counts, "sig"))
    some = F.broadcast(counts.filter(F.col("c") > hot))
    rows = materialize(_signed(docs, frequent, percent, shared).join(some, "sig", "left"), "signed")
    shared.destroy()
    cold = rows.filter("c IS NULL").select("sig", "id", "n").join(counts.filter(F.col("c") <= hot).hint("shuffle_merge"), "sig")
    every = rows.filter("c IS NOT NULL").unionByName(cold).select(F.col("alike").alias("sig"), "id", "n", "c").distinct()
    return materialize(every.withColumn("at", F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(2.0**53)), "postings"), hot


def bitmap(elements: np.ndarray) -> np.ndarray:
    """Parities of how many elements fall on each of at least twice as many bits (a power of two)."""
    bits = max(256, 2 << int(len(elements) - 1).bit_length()) if len(elements) else 256
    return np.packbits(np.bincount((elements & U64(bits - 1)).astype(np.int64), minlength=bits) & 1)


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _sets(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """(id, n, column) for the documents among ids; column: bits (bitmaps) or elements (whole sets)."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField(column, T.BinaryType())])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in blocks(batch.column("text")):
                sets, where, _, _ = shingles(data, at)
                own = (sets[x:y] for x, y in zip(where[:-1].tolist(), where[1:].tolist(), strict=True))
                raw = [(bitmap(x) if column == "bits" else x).tobytes() for x in own]
                yield _arrow([batch.column("id").slice(i, j - i), np.diff(where), pa.array(raw, pa.binary())], schema.names)

    return materialize(_only(docs, ids, "left_semi").mapInArrow(sets_of, schema), column)


def _may_link(p: int, q: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of q elements and bitmaps y (rows) can be alike enough to one of p with bitmap x.

    Bits that differ are a lower bound of the elements that only one of them has: with d such, (p + q - d) / 2 are shared at most.
    """
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return 100 * (p + q - apart) >= percent * (p + q + apart)


def _verified(docs: DataFrame, likely: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough. Sets are made for documents in pairs, and travel once for each pair."""
    ids = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    both = _with_both(likely, _sets(docs, ids, "elements"), "elements")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                merged = np.concatenate((np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)))
                merged.sort()
                same = int(np.count_nonzero(merged[1:] == merged[:-1]))
                keep.append(100 * same >= percent * (len(merged) - same))
            keep = pa.array(keep, pa.bool_())
            yield _arrow([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return materialize(both.mapInArrow(compare, _long("a", "b")), "links")


def _with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with sizes n1, n2 and the column's values x, y of both."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col(column).alias("x")).hint("shuffle_merge"), "a")
    return one.join(sets.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col(column).alias("y")).hint("shuffle_merge"), "b").select("a", "b", "n1", "n2", "x", "y")


def _likely(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps don't rule out."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q, x, y in zip(batch.column("n1").to_pylist(), batch.column("n2").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                keep.append(bool(_may_link(p, np.array([q]), _folded(x, size), _folded(y, size)[None], percent)[0]))
            keep = pa.array(keep, pa.bool_())
            yield _arrow([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return materialize(_with_both(pairs, bits, "bits").mapInArrow(compare, _long("a", "b")), "likely")


def likely_in_block(ids: np.ndarray, n: np.ndarray, g: np.ndarray, side: np.ndarray, bits: list[np.ndarray], percent: int, met: list[int] | None = None) -> np.ndarray:
    """Pairs (rows of ids, larger first) of different components g and different sides (or both of side 2) that may link.

    met: a bit mask for each set; pairs with a bit in common are compared elsewhere.
    """
    order = np.argsort(n, kind="stable")
    ids, n, g, side, bits = ids[order], n[order], g[order], side[order], [bits[k] for k in order]
    met = [met[k] for k in order] if met else [0] * len(ids)
    width = np.array([len(x) for x in bits])
    # Sizes in reach differ by less than a factor of two, so a row meets bitmaps of its own width and of the next.
    rows, folded = {}, {}
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        rows[w] = (at[0], np.stack([bits[k] for k in at]))
        folded[w] = rows[w][1][:, : w // 2] ^ rows[w][1][:, w // 2 :]
    end = np.searchsorted(percent * n, 100 * n, "right")
    out = []
    for i in range(len(ids)):
        for w, table in ((width[i], rows), (2 * width[i], folded)):
            if w not in rows:
                continue
            first, last = max(i + 1, rows[w][0]), min(int(end[i]), rows[w][0] + len(rows[w][1]))
            if first >= last:
                continue
            y = (rows[w][1] if table is rows else folded[w])[first - rows[w][0] : last - rows[w][0]]
            fits = (g[first:last] != g[i]) & ((side[first:last] != side[i]) | (side[i] == 2)) & _may_link(int(n[i]), n[first:last], bits[i], y, percent)
            hits = first + np.flatnonzero(fits)
            if met[i]:
                hits = hits[[not met[i] & met[j] for j in hits.tolist()]] if len(hits) else hits
            out.append(np.stack([np.maximum(ids[hits], ids[i]), np.minimum(ids[hits], ids[i])], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _likely_across(rest: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in one signature but different components that bitmaps don't rule out.

    rest: (sig, c, id, g, at). A signature's sets are cut into blocks by place; each pair of blocks is a task's unit, so a hot
    signature is spread, and no pair becomes a row unless it may link. Two sets with several signatures in common are compared
    for the least of these only: every row brings its set's signatures, which are no more than the set has elements to sign with.
    """
    every = rest.groupBy("id").agg(F.collect_list("sig").alias("sigs"))
    parts = F.ceil(F.col("c") / BLOCK_SETS)
    rows = rest.withColumns({"k": F.floor(F.col("at") * parts), "other": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))})
    side = F.when(F.col("k") == F.col("other"), 2).when(F.col("k") < F.col("other"), 0).otherwise(1)
    rows = rows.select("sig", F.least("k", "other").alias("lo"), F.greatest("k", "other").alias("hi"), "id", "g", side.alias("side"))
    dealt = rows.join(bits.join(every, "id"), "id").select("sig", "lo", "hi", "id", "g", "side", "n", "bits", "sigs").repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in t["bits"].combine_chunks()]
            ids, n, g, side = (t[c].to_numpy() for c in ("id", "n", "g", "side"))
            own, places, met = t["sig"][0].as_py(), {}, []
            for sigs in t["sigs"].to_pylist():
                met.append(sum(1 << places.setdefault(x, len(places)) for x in sigs if x < own))
            found = likely_in_block(ids, n, g, side, raw, percent, met)
            held.clear()
            if len(found):
                yield _arrow([np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])], ["a", "b"])

        key = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("sig", "lo", "hi")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    if held and tuple(keys[i]) != key:
                        yield from pairs()
                    key = tuple(keys[i])
                    held.append(batch.slice(i, j - i))
        if held:
            yield from pairs()

    return materialize(dealt.mapInArrow(compare, _long("a", "b")).distinct(), "likely")


def _near_size(x: str, y: str, percent: int) -> F.Column:
    return (100 * F.least(x, y) >= percent * F.greatest(x, y))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: key, n_shingles, component_id (the least key reachable by links, itself included).

    Rows link when 100 * |x and y| >= percent * |x or y|. Null texts and those without words have no shingles and are
    linked with nothing. Keys are integers that name one text each; rows of a repeated key stay as they are. A row with
    a null key keeps its count and has a component only through equal texts. Other columns are not read.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    scanned = materialize(_scan(docs), "shingle-scan")
    frequent = _frequent(scanned)
    rows = scanned.filter("kind = 0").select("id", "n", "a", "b")

    copies = rows.filter("n > 0").groupBy("a", "b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    copies = materialize(copies, "copies")
    few = copies.count() <= BROADCAST_ROWS
    named = rows.join(F.broadcast(copies) if few else copies, ["a", "b"], "left").select("id", "n", F.coalesce(F.when(F.col("n") > 0, F.col("rep")), F.col("id")).alias("rep"))
    named = materialize(named, "named")

    nodes = _only(docs, named.filter("rep <> id").select("id").distinct(), "left_anti")
    postings, hot = _postings(nodes, frequent, percent)
    leads = F.col("at") * F.col("c") < HUBS
    hub = postings.filter(leads).select("sig", "c", F.col("id").alias("b"), F.col("n").alias("m"), F.col("at").alias("before"))
    later = (F.col("before") < F.col("at")) | (F.col("before") == F.col("at")) & (F.col("b") < F.col("id"))
    first = _by_signature(postings, hub, hot).filter(later & _near_size("n", "m", percent)).select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b"))
    first = materialize(first.filter("a <> b").distinct(), "pairs")
    bits = _sets(nodes, postings.select("id").distinct(), "bits")
    links = _verified(nodes, _likely(first, bits, percent), percent)
    groups = components(links)

    # Signatures whose other sets lie in several components still: all pairs between these.
    rest = postings.filter(~leads).join(groups.withColumnRenamed("node", "id"), "id", "left").select("sig", "c", "id", "at", F.coalesce("component", "id").alias("g"))
    rest = materialize(rest, "rest")
    apart = materialize(rest.groupBy("sig", "c").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi").select("sig", "c"), "apart")
    second = _likely_across(_by_signature(rest, apart, hot, "left_semi"), bits, percent)
    if not second.isEmpty():
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = components(stars.unionByName(_verified(nodes, second, percent)))

    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    groups = groups.withColumnRenamed("node", "rep")
    out = named.join(F.broadcast(groups) if few else groups, "rep", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
