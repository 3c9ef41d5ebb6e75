"""Document versions, snapshots, annotations and incremental synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What stands in place of a disabled passage. Fixed value.
REDACTED = "（已省略被禁用内容）"


def latest(rows: DataFrame, key: str, order: str = "id") -> DataFrame:
    """The row of largest order for each key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).filter("__r = 1").drop("__r")


def upsert(current: DataFrame, changes: DataFrame, key: str = "chunk_id", order: str = "seq") -> DataFrame:
    """current with changes laid over it: for each key the row of largest order wins, changes over equal ones."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return both.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc(), F.col("__new").desc()))).filter("__r = 1").drop("__r", "__new")


def plan_version(history: DataFrame, uploads: DataFrame) -> DataFrame:
    """What an upload (doc_id, content_hash, parse_fp, chunk_fp, embedding_version) becomes.

    FIRST 1.0 without history; DUPLICATE of the active version with all four fingerprints equal; else MINOR if the basis
    (the active version, without one the newest) has the content, MAJOR if not, numbered after the largest version.
    history: (doc_id, id, major, minor, active, the fingerprints); of several active versions the newest counts.
    """
    prints = ("content_hash", "parse_fp", "chunk_fp", "embedding_version")
    basis = F.max_by(F.struct("active", *prints), F.struct("active", "id")).alias("b")
    known = history.groupBy("doc_id").agg(F.max(F.struct("major", "minor")).alias("top"), basis)
    found = uploads.join(known, "doc_id", "left")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"b.{c}"))
    first = F.col("top").isNull()
    duplicate = F.col("b.active") & same(prints[0]) & same(prints[1]) & same(prints[2]) & same(prints[3])
    action = F.when(first, "FIRST").when(duplicate, "DUPLICATE").when(same("content_hash"), "MINOR").otherwise("MAJOR")
    minor = F.concat_ws(".", F.col("top.major").cast("string"), (F.col("top.minor") + 1).cast("string"))
    version = F.when(first, "1.0").when(duplicate, None).when(same("content_hash"), minor).otherwise(F.concat((F.col("top.major") + 1).cast("string"), F.lit(".0")))
    return found.select("doc_id", action.alias("action"), version.alias("version"))


def reuse_level(history: DataFrame, uploads: DataFrame) -> DataFrame:
    """The most an upload can take over: CHUNKS (content, parse and split equal, READY), PARSED (content and parse equal), NONE; with
    the version it comes from, the first of that level. Either needs a parsed object that isn't blank."""
    h = history.select("doc_id", F.col("id").alias("from_id"), "status", "parsed_object", *(F.col(c).alias(f"h_{c}") for c in ("content_hash", "parse_fp", "chunk_fp")))
    equal = lambda c: F.col(c) == F.col(f"h_{c}")
    parsed = equal("content_hash") & equal("parse_fp") & (F.trim("parsed_object") != "")
    level = F.when(parsed & equal("chunk_fp") & (F.col("status") == "READY"), 2).when(parsed, 1).otherwise(0)
    best = uploads.join(h, "doc_id", "left").withColumn("level", F.coalesce(level, F.lit(0))).groupBy("doc_id").agg(F.max(F.struct("level", F.when(F.col("level") > 0, -F.col("from_id")).alias("m"))).alias("b"))
    return best.select("doc_id", F.element_at(F.array(F.lit("NONE"), F.lit("PARSED"), F.lit("CHUNKS")), F.col("b.level") + 1).alias("reuse"), (-F.col("b.m")).alias("from_id"))


def to_archive(versions: DataFrame, pinned: DataFrame, keep: int = 3, key: str = "doc_id") -> DataFrame:
    """READY versions beyond the newest keep of each document, but active and pinned ones. A missing time counts as oldest."""
    free = versions.filter((F.col("status") == "READY") & ~F.col("active")).join(pinned.select("version_id").distinct(), "version_id", "left_anti")
    order = W.partitionBy(key).orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())
    return free.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") > keep).drop("__r")


def activate(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets (doc_id, version_id) become ACTIVE, versions that were become READY."""
    t = targets.select("doc_id", F.col("version_id").alias("__t"))
    out = versions.join(t, "doc_id", "left")
    status = F.when(F.col("version_id") == F.col("__t"), "ACTIVE").when(F.col("__t").isNotNull() & (F.col("status") == "ACTIVE"), "READY").otherwise(F.col("status"))
    return out.withColumn("status", status).withColumn("active", F.col("status") == "ACTIVE").drop("__t")


def duplicates_of(documents: DataFrame) -> DataFrame:
    """Documents of equal content in a knowledge base, with the lowest id of the others. Repeats of a hot hash go through an aggregation, not a window."""
    first = documents.groupBy("kb_id", "content_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return documents.join(first, ["kb_id", "content_hash"]).filter("doc_id <> first_id").select("kb_id", "doc_id", F.col("first_id").alias("duplicate_of"))


def sync_objects(listing: DataFrame, items: DataFrame, truncated: bool) -> DataFrame:
    """Outcome of each object key of a listing (object_key, etag, failed) against stored items (object_key, etag, trashed, last_status).

    status, in this order: UNCHANGED for an equal etag; SKIPPED for a document in the trash; FAILED where the fetch failed; else
    SUCCESS. Stored objects that a whole listing no longer has become SKIPPED too, unless they are already; a truncated
    listing says nothing of them. detail: TRASHED, GONE, CREATED or UPDATED. A null etag is never equal.
    """
    a = listing.select("object_key", F.col("etag").alias("l_etag"), "failed", F.lit(True).alias("__l"))
    b = items.select("object_key", F.col("etag").alias("i_etag"), "trashed", "last_status", F.lit(True).alias("__i"))
    both = a.join(b, "object_key", "left" if truncated else "full_outer")
    gone, equal = F.col("__l").isNull(), F.coalesce(F.col("l_etag") == F.col("i_etag"), F.lit(False))
    both = both.filter(~gone | ~F.coalesce(F.col("last_status") == "SKIPPED", F.lit(False)))
    trashed = F.coalesce("trashed", F.lit(False))
    status = F.when(gone, "SKIPPED").when(equal, "UNCHANGED").when(trashed, "SKIPPED").when(F.col("failed"), "FAILED").otherwise("SUCCESS")
    detail = F.when(gone, "GONE").when(equal, None).when(trashed, "TRASHED").when(F.col("failed"), None).when(F.col("__i").isNull(), "CREATED").otherwise("UPDATED")
    return both.select("object_key", status.alias("status"), detail.alias("detail"))


def sync_status(outcomes: DataFrame, truncated: bool) -> DataFrame:
    """One row: a source is PARTIAL if any object failed or its listing was truncated, else SUCCESS."""
    return outcomes.agg(F.when((F.count_if(F.col("status") == "FAILED") > 0) | F.lit(truncated), "PARTIAL").otherwise("SUCCESS").alias("status"))


def sync_pages(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """Fate of fetched pages (id, tenant_id, host, url_hash, body_hash, auth_failed): one failed login blocks the rest of its host in the pass."""
    order = W.partitionBy("tenant_id", "host").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    blocked = F.coalesce(F.max(F.col("auth_failed").cast("int")).over(order) == 1, F.lit(False))
    both = fetched.withColumn("blocked", blocked).join(known.select("url_hash", F.col("body_hash").alias("known_hash")), "url_hash", "left")
    fate = F.when(F.col("blocked"), "BLOCKED").when(F.col("auth_failed"), "AUTH_FAILED").when(F.col("known_hash").isNull(), "CREATED").when(F.col("known_hash") == F.col("body_hash"), "UNCHANGED").otherwise("UPDATED")
    return both.select("id", "url_hash", fate.alias("fate"))


def inherit_annotations(annotations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Annotations (annotation_id, text_hash, enabled, id) on chunks of a new version (chunk_id, parent_id, text_hash): the last
    toggle of a hash counts, and a parent's goes to its children."""
    last = annotations.groupBy("text_hash").agg(F.max_by("enabled", "id").alias("enabled"), F.max("id").alias("annotation_id"))
    direct = chunks.join(last, "text_hash")
    children = chunks.select(F.col("chunk_id").alias("child"), F.col("parent_id").alias("chunk_id")).join(direct.select("chunk_id", "enabled", "annotation_id"), "chunk_id")
    both = direct.select("chunk_id", "enabled", "annotation_id", F.lit(1).alias("own")).unionByName(children.select(F.col("child").alias("chunk_id"), "enabled", "annotation_id", F.lit(0).alias("own")))
    return both.groupBy("chunk_id").agg(F.max_by("enabled", F.struct("own", "annotation_id")).alias("enabled"))


def contiguous(chunks: DataFrame) -> DataFrame:
    """Per group of chunks to merge (merge_id, doc_id, version_id, parent_id, seq): whether they follow one another in one parent."""
    gap = F.col("seq") - F.lag("seq").over(W.partitionBy("merge_id").orderBy("seq"))
    one = F.count_distinct(F.struct("doc_id", "version_id", F.coalesce("parent_id", F.lit("")))) == 1
    return chunks.withColumn("__g", F.coalesce(gap, F.lit(1))).groupBy("merge_id").agg((one & (F.min("__g") == 1) & (F.max("__g") == 1)).alias("mergeable"), F.count(F.lit(1)).alias("n"))


def resequence(chunks: DataFrame) -> DataFrame:
    """seq counted anew from 0 in each version."""
    return chunks.withColumn("seq", F.row_number().over(W.partitionBy("version_id").orderBy("seq", "chunk_id")) - 1)


def link_images(images: DataFrame, chunks: DataFrame, bucket: int = 4096) -> DataFrame:
    """Images (doc_id, image_id, start, stop) on the chunks (doc_id, chunk_id, start, stop) whose text they overlap.

    Both are dealt to the buckets of offsets that they touch, so the range condition becomes an equi-join with a check.
    """
    touch = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.greatest(F.col("stop") - 1, F.col("start"))) / bucket)))
    a = images.withColumn("b", touch).select("doc_id", "b", "image_id", F.col("start").alias("s1"), F.col("stop").alias("e1"))
    b = chunks.withColumn("b", touch).select("doc_id", "b", "chunk_id", F.col("start").alias("s2"), F.col("stop").alias("e2"))
    return a.join(b, ["doc_id", "b"]).filter("s1 < e2 AND s2 < e1").select("doc_id", "image_id", "chunk_id").distinct()


def union_length(spans: DataFrame, *by: str) -> DataFrame:
    """Length of the union of intervals (start, stop) in each group."""
    before = F.max("stop").over(W.partitionBy(*by).orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
    return spans.withColumn("__p", part).groupBy(*by).agg(F.sum("__p").alias("length"))


def hide_parents(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """Units without those whose parent has a disabled child."""
    hidden = chunks.filter(~F.col("enabled") & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("unit_id")).distinct()
    return units.join(hidden, "unit_id", "left_anti")


def redact(content: Column, spans: Column, mark: str = REDACTED) -> Column:
    """content with the spans (array of start, stop) replaced by a mark each. With an invalid span nothing is replaced.

    Where spans overlap, one ends where the next begins; of those that begin together the first in the array counts.
    """
    n = F.char_length(content)
    valid = F.forall(spans, lambda x: F.coalesce((x["start"] >= 0) & (x["stop"] > x["start"]) & (x["stop"] <= n), F.lit(False)))
    placed = F.array_sort(F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["stop"].alias("stop"))))
    firsts = F.filter(placed, lambda x: ~F.exists(placed, lambda y: (y["start"] == x["start"]) & (y["i"] < x["i"])))
    ends = F.concat(F.transform(F.slice(firsts, F.lit(2), F.greatest(F.size(firsts), F.lit(1))), lambda x: x["start"]), F.array(n))
    step = lambda s, x: F.struct(
        F.least(x["x"]["stop"], x["end"]).alias("at"), F.concat(s["out"], F.substring(content, s["at"] + 1, x["x"]["start"] - s["at"]), F.lit(mark)).alias("out")
    )
    pairs = F.zip_with(firsts, ends, lambda x, end: F.struct(x.alias("x"), end.alias("end")))
    done = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(content, s["at"] + 1, n)))
    return F.when(F.size(spans) == 0, content).when(valid, done).otherwise(content)
