"""Who may read what, and what a search or a console shows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.operators.recall import small


def readable(docs: DataFrame, grants: DataFrame, roles: list[str], reviewer: bool = False) -> DataFrame:
    """docs (doc_id, visibility) that a principal may read: RESTRICTED ones by the right to review or a role granted for them (doc_id, role_id)."""
    if reviewer:
        return docs
    given = grants.filter(F.col("role_id").isin(roles)).select("doc_id").distinct().withColumn("__g", F.lit(True))
    open_to_all = ~F.coalesce(F.col("visibility") == "RESTRICTED", F.lit(False))
    return docs.join(given, "doc_id", "left").filter(open_to_all | F.col("__g")).drop("__g")


def fenced(rows: DataFrame, tenant: str | None, exempt: bool = False) -> DataFrame:
    """Rows of the current tenant; all of them without a principal (tenant None) or for an exempt operator."""
    return rows if tenant is None or exempt else rows.filter(F.col("tenant_id") == tenant)


def principal_scope(user_roles: DataFrame, permissions: DataFrame, bases: DataFrame) -> DataFrame:
    """Per user (user_id, role_id): sorted distinct permissions and knowledge bases of all roles. permissions (role_id, permission), bases (role_id, kb_id)."""
    every = user_roles.select("user_id", "role_id").distinct()
    gathered = lambda of, name: every.join(of, "role_id").groupBy("user_id").agg(F.array_sort(F.collect_set(name)).alias(f"{name}s"))
    none = F.array().cast("array<string>")
    out = every.select("user_id").distinct().join(gathered(permissions, "permission"), "user_id", "left").join(gathered(bases, "kb_id"), "user_id", "left")
    return out.select("user_id", F.coalesce("permissions", none).alias("permissions"), F.coalesce("kb_ids", none).alias("kb_ids"))


def holds(text: Column, words: str) -> Column:
    """Whether text holds words as they are: no character of them is a wildcard. Case counts not."""
    return F.contains(F.lower(text), F.lit(words.lower()))


def begins(text: Column, words: str) -> Column:
    """Whether text begins with words as they are."""
    return F.startswith(text, F.lit(words))


def feedback_bases(feedback: DataFrame, insight: DataFrame, chunks: DataFrame) -> DataFrame:
    """feedback (id, request_id, chunk_id) with kb_id of its request (null for an unknown one) and owned, whether that base has the chunk."""
    asked = insight.groupBy("request_id").agg(F.max_by("kb_id", "id").alias("kb_id"))
    own = chunks.select("chunk_id", F.col("kb_id").alias("__own"))
    both = feedback.join(asked, "request_id", "left").join(own, "chunk_id", "left")
    return both.select("id", "kb_id", F.coalesce(F.col("kb_id") == F.col("__own"), F.lit(False)).alias("owned"))


def stale_reservations(rows: DataFrame, now: Column, timeout: Column) -> DataFrame:
    """Reservations that are older than the timeout in minutes, five at least."""
    return rows.filter((F.col("status") == "RESERVED") & (F.col("created_at") < now - F.make_dt_interval(mins=F.greatest(timeout, F.lit(5)))))


def rebuild_status(docs: DataFrame, running: tuple[str, ...], failed: tuple[str, ...] = ("FAILED",)) -> DataFrame:
    """Per knowledge base: documents with a current version that a changed configuration left stale, of them in progress and failed."""
    stale = docs.filter(F.col("config_stale") & F.col("current_version").isNotNull())
    return stale.groupBy("kb_id").agg(F.count(F.lit(1)).alias("stale"), F.count_if(F.col("process_status").isin(*running)).alias("in_progress"), F.count_if(F.col("process_status").isin(*failed)).alias("failed"))


def render_dictionary(words: DataFrame) -> DataFrame:
    """Per dict_type: the enabled words in order, a line each, with their SHA-256 and the time of their last change (0 without).

    A dictionary without enabled words is there, empty.
    """
    on = F.coalesce("enabled", F.lit(False))
    kept = words.groupBy("dict_type").agg(F.array_sort(F.collect_list(F.when(on, F.col("word")))).alias("w"), F.coalesce(F.max(F.when(on, F.col("updated_ms"))), F.lit(0)).alias("last_modified"))
    body = F.array_join(F.transform("w", lambda x: F.concat(x, F.lit("\n"))), "")
    return kept.select("dict_type", body.alias("body"), F.sha2(body, 256).alias("etag"), "last_modified", F.size("w").alias("entries"))


def online_metrics(calls: DataFrame) -> DataFrame:
    """Per source of calls (source, latency_ms, zero_hit, degraded): their number, total and largest latency, zero hits and degraded ones."""
    return calls.groupBy("source").agg(
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("total_ms"), F.max("latency_ms").alias("max_ms"), F.count_if("zero_hit").alias("zero_hits"), F.count_if("degraded").alias("degraded"),
    )


def pinned_versions(apps: DataFrame, versions: DataFrame) -> DataFrame:
    """Versions (doc_id, version_id) that an application's frozen list (app_id, visible_versions: a JSON array) holds."""
    frozen = apps.select("app_id", F.explode(F.from_json("visible_versions", "array<string>")).alias("version_id")).distinct()
    return versions.join(frozen, "version_id").select("doc_id", "version_id", "app_id")


def resolved_indexes(apps: DataFrame, live: DataFrame, indexes: DataFrame, restricted: DataFrame) -> DataFrame:
    """Per app (app_id, kb_id, fulltext_index, vector_index, frozen) what it searches: its snapshot if that is whole (a named vector index
    counts), else the live index and versions (kb_id, live_index, versions) of its base, marked degraded.

    An app without a snapshot or with a frozen list that is null or empty searches what is live, and is not degraded. Of either list of
    versions those go that the caller may not see: restricted (kb_id, hidden), all three arrays.
    """
    there = indexes.select("index_name").distinct()
    text = there.select(F.col("index_name").alias("fulltext_index"), F.lit(True).alias("__t"))
    vector = there.select(F.col("index_name").alias("vector_index"), F.lit(True).alias("__v"))
    both = apps.join(small(text), "fulltext_index", "left").join(small(vector), "vector_index", "left").join(live, "kb_id", "left").join(small(restricted), "kb_id", "left")
    meant = F.col("fulltext_index").isNotNull() & F.coalesce(F.size("frozen") > 0, F.lit(False))
    whole = meant & F.col("__t").isNotNull() & (F.col("vector_index").isNull() | F.col("__v").isNotNull())
    versions = F.when(whole, F.col("frozen")).otherwise(F.col("versions"))
    seen = F.filter(versions, lambda x: ~F.coalesce(F.array_contains("hidden", x), F.lit(False)))
    return both.select("app_id", F.when(whole, F.col("fulltext_index")).otherwise(F.col("live_index")).alias("index_name"), seen.alias("versions"), (meant & ~whole).alias("degraded"))


def snapshots_to_archive(snapshots: DataFrame, keep: int = 3) -> DataFrame:
    """SUPERSEDED snapshots beyond the newest keep of each app; without a release time they count as oldest."""
    order = W.partitionBy("app_id").orderBy(F.col("released_at").desc_nulls_last(), F.col("id").desc())
    return snapshots.filter("status = 'SUPERSEDED'").withColumn("__r", F.row_number().over(order)).filter(F.col("__r") > keep).drop("__r")


#: Next states of an application's version. Fixed values.
APP_STATES = {
    "DRAFT": ("TESTING",), "TESTING": ("GATING", "GATE_PASSED", "GATE_LOG_ONLY", "GATE_BLOCKED"), "GATING": ("GATE_PASSED", "GATE_LOG_ONLY", "GATE_BLOCKED"),
    "GATE_PASSED": ("RELEASED",), "GATE_LOG_ONLY": ("RELEASED",), "GATE_BLOCKED": ("RELEASED",), "RELEASED": ("SUPERSEDED",), "SUPERSEDED": ("RELEASED",),
}


def may_become(state: Column, target: Column) -> Column:
    """Whether a version may go from one state to another."""
    allowed = F.lit(False)
    for a, following in APP_STATES.items():
        allowed = allowed | ((state == a) & target.isin(*following))
    return F.coalesce(allowed, F.lit(False))


def business_id(prefix: str, *key: Column) -> Column:
    """An id of a prefix and the key's hash: the same for the same key, so a retried task makes no second one."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *(k.cast("string") for k in key)), 256), 1, 24))


def hydrate(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """units (query_id, unit_id, best, ...) with content: the parent's, or the best child's where the parent is missing; hydrated: PARENT, CHILD or null."""
    text = chunks.select("chunk_id", "content")
    parent = text.select(F.col("chunk_id").alias("unit_id"), F.col("content").alias("__p"))
    child = text.select(F.col("chunk_id").alias("best"), F.col("content").alias("__c"))
    both = units.join(parent, "unit_id", "left").join(child, "best", "left")
    source = F.when(F.col("__p").isNotNull(), "PARENT").when(F.col("__c").isNotNull(), "CHILD")
    return both.withColumn("content", F.coalesce("__p", "__c")).withColumn("hydrated", source).drop("__p", "__c")


def disabled_children(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """parents (chunk_id) with the disabled children of each, in order: array of (seq, start, stop)."""
    off = chunks.filter(~F.col("enabled") & F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop"))).alias("children"))
    return parents.join(off, "chunk_id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<struct<seq:bigint,start:bigint,stop:bigint>>")))


def node_view(hits: DataFrame, children: DataFrame) -> DataFrame:
    """What a search returns of each hit (query_id, unit_id, position, score, content, doc_id): text, metadata with scores, children best first.

    children (query_id, unit_id, chunk_id, score): the matched chunks of a unit.
    """
    held = children.groupBy("query_id", "unit_id").agg(F.collect_list(F.struct((-F.col("score")).alias("o"), "chunk_id", "score")).alias("l"))
    shaped = F.transform(F.array_sort("l"), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score")))
    meta = F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("rank"), F.col("position").cast("string"), F.lit("score"), F.format_number("score", 6))
    return hits.join(held, ["query_id", "unit_id"], "left").select("query_id", "position", F.col("unit_id").alias("node_id"), F.col("content").alias("text"), meta.alias("metadata"), shaped.alias("children"))


#: What a search says of a hit's scores, and the column that has it. Fixed values.
SCORES = {
    "fused_score": "fused_score", "vector_score": "route_scores.VECTOR", "vector_rank": "route_ranks.VECTOR", "norm_vector_score": "normalized_scores.VECTOR", "bm25_score": "route_scores.BM25", "bm25_rank": "route_ranks.BM25",
    "norm_bm25_score": "normalized_scores.BM25", "rerank_score": "rerank_score", "graph_score": "graph_score", "graph_hops": "graph_hops",
}


def score_metadata(hits: DataFrame) -> Column:
    """Map of SCORES of hits, of those that are there: columns may lack, maps (by route) may lack a route, values may be null."""
    def value(place: str) -> Column:
        name, _, route = place.partition(".")
        if name not in hits.columns:
            return F.lit(None).cast("double")
        return (F.col(name)[route] if route else F.col(name)).cast("double")

    every = F.map_from_arrays(F.array(*map(F.lit, SCORES)), F.array(*map(value, SCORES.values())))
    return F.map_filter(every, lambda k, v: v.isNotNull())


def flattened_metadata(metadata: Column, reserved: list[str], prefix: str = "ext_") -> Column:
    """A map of texts with prefixed keys, without reserved keys and blank values."""
    kept = F.map_filter(metadata, lambda k, v: ~k.isin(*reserved) & F.coalesce(F.trim(v) != "", F.lit(False)))
    return F.transform_keys(kept, lambda k, v: F.concat(F.lit(prefix), k))


def flattened_lists(metadata: Column, reserved: list[str], prefix: str = "ext_") -> Column:
    """flattened_metadata for a map of lists of texts: keys whose lists hold something that isn't blank, with what they hold of it."""
    full = F.transform_values(metadata, lambda k, v: F.filter(v, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))))
    kept = F.map_filter(full, lambda k, v: ~k.isin(*reserved) & (F.size(v) > 0))
    return F.transform_keys(kept, lambda k, v: F.concat(F.lit(prefix), k))


def epoch_ms(value: Column) -> Column:
    """Whole milliseconds of a text; null if it isn't a whole number."""
    return F.trim(value).try_cast("long")


def ordered_documents(hits: DataFrame) -> DataFrame:
    """Per query the distinct documents of its hits (query_id, position, doc_id), in the order that they come first."""
    held = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "doc_id"))).alias("l"))
    return held.select("query_id", F.array_distinct(F.transform("l", lambda x: x["doc_id"])).alias("doc_ids"))
