"""Agent memory, model answers as commands, and request rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.operators.text import json_object

#: Keys that a request may override, and the values that settings are held within.
OVERRIDES = ("top_n", "score_threshold", "metadata_filter", "max_content_length")
MOST_TOP_N, DEFAULT_TOP_N, MOST_RECALL, DEFAULT_RECALL = 20, 5, 100, 50
NAME_CHARS, TYPE_CHARS, MOST_COMMANDS, CONTENT_CHARS, VALUE_CHARS = 128, 64, 20, 2000, 512


def live(nodes: DataFrame, now: Column, library: str | None = None, user: str | None = None, rule: str | None = None) -> DataFrame:
    """Memories that haven't expired, of a library, user and rule if named."""
    out = nodes.filter(F.col("expire_at").isNull() | (F.col("expire_at") > now))
    for name, value in (("library_id", library), ("user_id", user), ("rule_id", rule)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def newest(nodes: DataFrame, now: Column, k: int = 50) -> DataFrame:
    """The newest k live memories of each user."""
    order = W.partitionBy("user_id").orderBy(F.col("id").desc())
    return live(nodes, now).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def expire_at(now: Column, days: Column) -> Column:
    """now and so many days; null for none."""
    return F.when(days.isNotNull(), now + F.make_dt_interval(days=days))


def text_score(score: Column) -> Column:
    """An open-ended text score mapped to 0..1."""
    return score / (score + 1)


def search(candidates: DataFrame, most: int, reranked: bool, threshold: float | None = None) -> DataFrame:
    """The best memories of each query (query_id, node_id, score, rerank_score). A threshold holds for rerank scores only."""
    score = F.col("rerank_score") if reranked else F.col("score")
    kept = candidates.filter(score >= threshold) if reranked and threshold is not None else candidates
    order = W.partitionBy("query_id").orderBy(score.desc(), "node_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def merge_profile(stored: Column, new: Column, allowed: list[str]) -> Column:
    """Profile attributes with new ones over them: allowed fields, names and values trimmed; values that are blank or over VALUE_CHARS don't count.

    Of several names that are one when trimmed, the last counts.
    """
    bare = lambda x: F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    given = F.transform(F.map_entries(new), lambda e: F.struct(bare(e["key"]).alias("key"), bare(e["value"]).alias("value")))
    units = lambda v: F.octet_length(F.encode(v, "UTF-16BE")) / 2
    fit = F.filter(given, lambda e: F.coalesce((e["value"] != "") & (units(e["value"]) <= VALUE_CHARS), F.lit(False)))
    last = lambda name: F.try_element_at(F.filter(fit, lambda e: e["key"] == name), F.lit(-1))
    fresh = F.map_from_entries(F.array_compact(F.array(*(last(name) for name in allowed))))
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return F.map_concat(kept, fresh)


def memory_commands(answer: Column, known: Column, allow_update: bool = True) -> Column:
    """Commands (event, node_id, content) of a model's answer {"memories": [{"event", "node_id", "content"}]}; none for another shape.

    Contents are trimmed; blank ones and those over CONTENT_CHARS go; the first MOST_COMMANDS of the others count. An UPDATE of a node in
    known stays one where updates are allowed; all else is an ADD.
    """
    trimmed = lambda c, name: F.nullif(F.trim(c[name]), F.lit(""))
    parsed = F.from_json(json_object(answer), "memories array<struct<event:string,node_id:string,content:string>>")["memories"]
    usable = F.filter(F.coalesce(parsed, F.array()), lambda c: F.coalesce(F.char_length(trimmed(c, "content")) <= CONTENT_CHARS, F.lit(False)))
    update = lambda c: F.lit(allow_update) & F.coalesce((F.upper(F.trim(c["event"])) == "UPDATE") & F.array_contains(known, trimmed(c, "node_id")), F.lit(False))
    return F.transform(
        F.slice(usable, 1, MOST_COMMANDS),
        lambda c: F.struct(F.when(update(c), "UPDATE").otherwise("ADD").alias("event"), F.when(update(c), trimmed(c, "node_id")).alias("node_id"), trimmed(c, "content").alias("content")),
    )


def graph_extraction(answer: Column) -> Column:
    """struct(entities, relations) of a model's answer; null without an array of entities or with a name over NAME_CHARS.

    Names are trimmed, blank ones skipped; of repeated entities the first type counts; a type has TYPE_CHARS at most and a
    default; a relation needs both its ends among the entities.
    """
    parsed = F.from_json(json_object(answer), "entities array<struct<name:string,type:string>>, relations array<struct<source:string,target:string,type:string>>")
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    kind = lambda c, default: F.substring(F.coalesce(trimmed(c), F.lit(default)), 1, TYPE_CHARS)
    entities = F.filter(parsed["entities"], lambda e: trimmed(e["name"]).isNotNull())
    names = F.transform(entities, lambda e: F.trim(e["name"]))
    first = F.filter(entities, lambda e, i: F.array_position(names, F.trim(e["name"])) == i + 1)
    shaped = F.transform(first, lambda e: F.struct(F.trim(e["name"]).alias("name"), kind(e["type"], "unknown").alias("type")))
    edges = F.filter(F.coalesce(parsed["relations"], F.array()), lambda r: F.coalesce(F.array_contains(names, F.trim(r["source"])) & F.array_contains(names, F.trim(r["target"])), F.lit(False)))
    cut = F.transform(edges, lambda r: F.struct(F.trim(r["source"]).alias("source"), F.trim(r["target"]).alias("target"), kind(r["type"], "related_to").alias("type")))
    return F.when(F.forall(names, lambda n: F.char_length(n) <= NAME_CHARS), F.struct(shaped.alias("entities"), cut.alias("relations")))


def rejected_overrides(keys: Column) -> Column:
    """Keys of a request that may not be overridden."""
    return F.array_except(keys, F.array(*map(F.lit, OVERRIDES)))


def setting(request: Column, base: Column, default: int, most: int) -> Column:
    """The first positive of request, knowledge base and default, within most."""
    positive = lambda c: F.when(c > 0, c)
    return F.least(F.coalesce(positive(request), positive(base), F.lit(default)), F.lit(most))


def routed(answer: Column, candidates: Column) -> Column:
    """Knowledge bases that a model chose, in the candidates' order; all of them if it chose none of these."""
    chosen = F.array_intersect(candidates, F.coalesce(F.from_json(answer, "array<string>"), F.array().cast("array<string>")))
    return F.when(F.size(chosen) > 0, chosen).otherwise(candidates)


def rewritten(answer: Column, query: Column, most: int = 512) -> Column:
    """A model's rewrite on one line, cut; the query itself if that is blank."""
    line = F.trim(F.regexp_replace(answer, r"\s+", " "))
    return F.when(F.coalesce(line, F.lit("")) != "", F.substring(line, 1, most)).otherwise(query)
