"""Chunk edits: copies of a version's chunks under new ids, splits, merges, and toggles that cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.operators.text import text_hash
from lexlake.operators.versions import contiguous

#: What merged chunks are joined by. Fixed value.
SEPARATOR = "\n"


def derived_id(*parts: Column) -> Column:
    """An id made of what it stands for, so that every table that names it finds the same one without a table of old and new ids."""
    return F.concat(F.lit("c"), F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256), 1, 32))


def copy_chunks(chunks: DataFrame, copies: DataFrame, embedding: bool = True) -> DataFrame:
    """The chunks of versions copied to others: copies (doc_id, from_version, to_version), chunks with chunk_id, doc_id, version_id, parent_id, enabled, and more.

    Ids are new; a parent's id is the copy's, null where the version has no such chunk. enabled is kept (null: true). indexable: not
    a parent of others; embedding_status: PENDING for what is indexable if embedding is set up, else SKIPPED. Other
    columns are kept. A version may be copied to several.
    """
    c = copies.select("doc_id", F.col("from_version").alias("version_id"), "to_version")
    own = chunks.join(c, ["doc_id", "version_id"])
    known = own.select("to_version", F.col("chunk_id").alias("parent_id"), F.lit(True).alias("__known")).distinct()
    parents = own.filter("trim(parent_id) <> ''").select("to_version", F.col("parent_id").alias("chunk_id"), F.lit(True).alias("__parent")).distinct()
    both = own.join(known, ["to_version", "parent_id"], "left").join(parents, ["to_version", "chunk_id"], "left")
    leaf = F.col("__parent").isNull()
    changed = {
        "chunk_id": derived_id(F.col("to_version"), F.col("chunk_id")), "parent_id": F.when(F.col("__known"), derived_id(F.col("to_version"), F.col("parent_id"))), "version_id": F.col("to_version"),
        "enabled": F.coalesce("enabled", F.lit(True)), "indexable": leaf, "embedding_status": F.when(leaf & F.lit(embedding), "PENDING").otherwise("SKIPPED"),
    }
    rest = [x for x in chunks.columns if x not in changed]
    return both.select(*(v.alias(k) for k, v in changed.items()), *rest)


def copy_links(links: DataFrame, copies: DataFrame, *ids: str) -> DataFrame:
    """Rows that name chunks of a version (images, annotations), for its copies: version_id and the columns ids become the copies'."""
    c = copies.select("doc_id", F.col("from_version").alias("version_id"), "to_version")
    new = {i: derived_id(F.col("to_version"), F.col(i)) for i in ids} | {"version_id": F.col("to_version")}
    return links.join(c, ["doc_id", "version_id"]).select(*((F.when(F.col(x).isNotNull(), new[x]) if x in ids else new[x]).alias(x) if x in new else F.col(x) for x in links.columns))


def splittable(content: Column, offsets: Column) -> Column:
    """Whether offsets are there, ascend strictly, and lie inside of content."""
    n = F.char_length(F.coalesce(content, F.lit("")))
    inside = F.forall(offsets, lambda x: F.coalesce((x > 0) & (x < n), F.lit(False)))
    rising = F.forall(F.zip_with(offsets, F.slice(offsets, 2, F.greatest(F.size(offsets) - 1, F.lit(0))), lambda a, b: b.isNull() | (b > a)), lambda x: x)
    return offsets.isNotNull() & (F.size(offsets) > 0) & F.coalesce(inside & rising, F.lit(False))


def split_chunks(chunks: DataFrame, splits: DataFrame) -> DataFrame:
    """chunks (chunk_id, version_id, parent_id, seq, content, enabled, ...) after splits (chunk_id, offsets): one row per chunk that is left or made.

    A chunk's parts take its place: seq counts on from its own, and of what follows it under the same parent is moved by what
    splits before it add. Parts keep the other columns; part says which they are (null: not split), and chunk_id is
    new. Children of a split chunk go, since its parts are cut anew (cut_children). Splits that are not splittable, or name
    no chunk, change nothing. One split a chunk.
    """
    asked = splits.select("chunk_id", F.col("offsets").cast("array<int>").alias("__offsets"))
    marked = chunks.join(asked, "chunk_id", "left").withColumn("__offsets", F.when(splittable(F.col("content"), F.col("__offsets")), F.col("__offsets")))
    more = F.coalesce(F.size("__offsets"), F.lit(0))
    more = F.when(F.col("__offsets").isNull(), 0).otherwise(more).cast("long")
    before = W.partitionBy("version_id", "parent_id").orderBy("seq").rangeBetween(W.unboundedPreceding, -1)
    placed = marked.withColumn("seq", (F.col("seq") + F.coalesce(F.sum(more).over(before), F.lit(0))).cast(chunks.schema["seq"].dataType))
    # A chunk without a parent is dealt by its own id: else all of them, with their texts, would lie in one task.
    gone = marked.filter("__offsets IS NOT NULL").select(F.struct(F.col("chunk_id").alias("id"), F.lit(0).cast("long").alias("own")).alias("__key"))
    own = F.when(F.col("parent_id").isNull(), F.xxhash64("chunk_id")).otherwise(F.lit(0).cast("long"))
    placed = placed.withColumn("__key", F.struct(F.col("parent_id").alias("id"), own.alias("own"))).join(gone, "__key", "left_anti").drop("__key")
    edges = F.concat(F.array(F.lit(0)), F.coalesce("__offsets", F.array().cast("array<int>")), F.array(F.char_length(F.coalesce("content", F.lit("")))))
    cut = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.struct(F.get(edges, i).alias("start"), (F.get(edges, i + 1) - F.get(edges, i)).alias("length")))
    parts = placed.select("*", F.posexplode(cut).alias("__part", "__cut"))
    split = F.col("__offsets").isNotNull()
    changed = {
        "chunk_id": F.when(split, derived_id(F.col("chunk_id"), F.col("__cut.start"))).otherwise(F.col("chunk_id")),
        "seq": (F.col("seq") + F.when(split, F.col("__part")).otherwise(0)).cast(chunks.schema["seq"].dataType),
        "content": F.when(split, F.substring("content", F.col("__cut.start") + 1, F.col("__cut.length"))).otherwise(F.col("content")),
    }
    out = parts.select(*(changed[x].alias(x) if x in changed else F.col(x) for x in chunks.columns), F.when(split, F.col("__part")).alias("part"), F.when(split, F.col("chunk_id")).alias("split_from"))
    return out.withColumn("text_hash", F.when(F.col("part").isNotNull(), text_hash(F.col("content"))).otherwise(F.col("text_hash"))) if "text_hash" in chunks.columns else out


def merge_chunks(chunks: DataFrame, merges: DataFrame) -> DataFrame:
    """One chunk for each group of merges (merge_id, chunk_id) that may be merged; chunk_ids are those that it replaces, in order.

    May: two or more chunks, all there and each once, of one version and parent, following one another by seq. The first gives its
    place; contents are joined by a line end; enabled if any was.
    """
    named = merges.groupBy("merge_id").agg(F.count(F.lit(1)).alias("__asked"), F.count_distinct("chunk_id").alias("__once"))
    rows = merges.join(chunks, "chunk_id")
    fine = contiguous(rows).join(named, "merge_id").filter("mergeable AND n >= 2 AND n = __asked AND __asked = __once").select("merge_id")
    held = rows.join(fine, "merge_id").groupBy("merge_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "chunk_id", F.coalesce("content", F.lit("")).alias("content")))).alias("m"), F.min_by(F.struct("doc_id", "version_id", "parent_id"), F.struct("seq", "chunk_id")).alias("f"),
        F.max(F.coalesce("enabled", F.lit(False))).alias("enabled"),
    )
    ids = F.transform("m", lambda x: x["chunk_id"])
    content = F.array_join(F.transform("m", lambda x: x["content"]), SEPARATOR)
    return held.select(derived_id(F.array_join(ids.cast("array<string>"), ",")).alias("chunk_id"), "f.*", F.col("m")[0]["seq"].alias("seq"), content.alias("content"), text_hash(content).alias("text_hash"), "enabled", ids.alias("chunk_ids"))


def toggle_chunks(chunks: DataFrame, toggles: DataFrame) -> DataFrame:
    """chunks after toggles (id, chunk_id, enabled), taken in order of id; each also sets the chunk's children. changed_by: the toggle that made a
    chunk other than it was (null: it is as before); cascaded: whether that toggle named its parent."""
    own = toggles.select("id", "chunk_id", F.col("enabled").alias("__to"), F.lit(False).alias("__of_parent"))
    below = chunks.filter("parent_id IS NOT NULL").select(F.col("chunk_id").alias("child"), "parent_id").join(toggles.withColumnRenamed("chunk_id", "parent_id"), "parent_id")
    both = own.unionByName(below.select("id", F.col("child").alias("chunk_id"), F.col("enabled").alias("__to"), F.lit(True).alias("__of_parent")))
    last = both.groupBy("chunk_id").agg(F.max(F.struct("id", ~F.col("__of_parent"), "__to", "__of_parent")).alias("t"))
    out = chunks.join(last, "chunk_id", "left")
    changed = F.col("t").isNotNull() & ~F.col("t.__to").eqNullSafe(F.col("enabled"))
    return out.select(*(F.coalesce("t.__to", "enabled").alias(c) if c == "enabled" else F.col(c) for c in chunks.columns), F.when(changed, F.col("t.id")).alias("changed_by"), F.when(changed, F.col("t.__of_parent")).alias("cascaded"))
