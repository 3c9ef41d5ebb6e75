"""Property-graph operators over edge and mention tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.operators.recall import small
from lexlake.storage import materialize


def reach(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """Nodes within 0..hops undirected steps of the seeds (seed, node), with the least number of steps.

    A frontier is expanded once for each step (at most 5) and loses nodes reached before, so paths are never enumerated.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    found = [seeds.select("seed", "node").distinct().withColumn("hops", F.lit(0))]
    for k in range(1, max(0, min(hops, 5)) + 1):
        near = found[-1].select("seed", F.col("node").alias("src")).join(both, "src").select("seed", F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, [f.select("seed", "node") for f in found])
        found.append(materialize(near.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(k)), "frontier"))
    return reduce(DataFrame.unionByName, found)


def match_entities(entities: DataFrame, terms: DataFrame, limit: int = 10) -> DataFrame:
    """Entities (entity, name) whose name shares terms with a query (query_id, term): match_score, the share of the best, of the first limit."""
    from pyspark.sql import Window as W

    from lexlake.operators.recall import tokens

    named = entities.select("entity", "name", F.explode(F.array_distinct(tokens(F.col("name")))).alias("term"))
    hits = named.join(small(terms), "term").groupBy("query_id", "entity", "name").agg(F.count(F.lit(1)).alias("c"))
    hits = hits.withColumn("raw", F.col("c") / F.size(F.array_distinct(tokens(F.col("name"))))).withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("raw").desc(), "entity")))
    return hits.filter(F.col("r") <= limit).withColumn("match_score", F.col("raw") / F.max("raw").over(W.partitionBy("query_id"))).select("query_id", "entity", "name", "match_score")


def graph_route(matches: DataFrame, edges: DataFrame, mentions: DataFrame, hops: int = 2) -> DataFrame:
    """Trace rows for graph_relevance: chunks that mention entities within hops of a matched one."""
    seeds = matches.select("entity").distinct().select(F.col("entity").alias("seed"), F.col("entity").alias("node"))
    near = reach(edges, seeds, hops)
    return matches.join(near, matches["entity"] == near["seed"]).join(mentions.withColumnRenamed("entity", "node"), "node").select("query_id", "chunk_id", F.col("name").alias("entity_name"), "match_score", "hops")


def admitted(rows: DataFrame, chunks: DataFrame, kb_id: str, versions: DataFrame) -> DataFrame:
    """Rows whose chunk is enabled, in the knowledge base and in a visible version."""
    kept = chunks.filter(F.col("enabled") & (F.col("kb_id") == kb_id)).join(small(versions), "document_version_id", "left_semi")
    return rows.join(kept.select("chunk_id"), "chunk_id", "left_semi")


def summary(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    one = lambda df, c, name: df.agg(F.count_distinct(c).alias(name))
    return one(entities, "entity", "entities").join(edges.agg(F.count(F.lit(1)).alias("relations"))).join(one(mentions, "chunk_id", "chunks"))


def entity_listing(entities: DataFrame, edges: DataFrame, mentions: DataFrame, keyword: str | None = None, relations: int = 20) -> DataFrame:
    """Entities by the number of chunks that mention them, with their first outgoing relations.

    Relations are ranked and cut before they are gathered, so an entity of very many holds no more of them than others.
    """
    kept = entities if keyword is None else entities.filter(F.contains(F.lower("name"), F.lit(keyword.lower())))
    named = edges.select(F.col("src").alias("entity"), F.concat_ws(":", "type", F.col("dst").cast("string")).alias("relation")).distinct()
    first = named.withColumn("__r", F.row_number().over(W.partitionBy("entity").orderBy("relation"))).filter(F.col("__r") <= relations)
    out = first.groupBy("entity").agg(F.array_sort(F.collect_list("relation")).alias("relations"))
    chunks = mentions.groupBy("entity").agg(F.count_distinct("chunk_id").alias("chunk_count"))
    joined = kept.join(chunks, "entity", "left").join(out, "entity", "left")
    return joined.select("entity", "name", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("relations", F.array().cast("array<string>")).alias("relations")).orderBy(F.col("chunk_count").desc(), "name")
