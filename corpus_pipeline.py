"""A training-data pipeline over ``documents``: language, quality, near copies, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; what it returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.llm import jaccard, language, packing, quality
from lexlake.llm.queries import tokenizer
from lexlake.storage import BROADCAST_ROWS, materialize, small_batches, table

#: A text stays if this share of its n-grams is known in its language: gibberish has next to none.
LEAST_HIT_RATE = 0.1


def _row(docs: DataFrame, first: tuple[str, ...] = ()) -> F.Column:
    """Whole rows as one column, so that no name of theirs clashes; the named fields lead."""
    return F.struct(*(F.col(f"`{c}`") for c in [*first, *(c for c in docs.columns if c not in first)]))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the labelled rows teach; null texts, texts without letters and gibberish go.

    Rows stay whole, repeated ones and those of null ids too; an empty table stays empty. Only texts go to Python.
    """
    small_batches(spark)
    found = language.language_of(spark, language.train(docs))(F.col("text"))
    judged = docs.select(_row(docs).alias("row"), found.alias("found"))
    return judged.filter((F.col("found.lang_pred") != language.UNKNOWN) & (F.col("found.hit_rate") >= LEAST_HIT_RATE)).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules, from hosts that do. Null and empty texts go.

    Rows stay whole, repeated ones and those of null ids too; those of null hosts are judged as of one host.
    """
    small_batches(spark)
    judged = docs.select(_row(docs).alias("row"), F.col("source").alias("host"), quality.counts_of(F.col("text")).alias("counts"))
    judged = judged.select("row", "host", "counts.*").withColumn("base_failed", quality.base_failed())
    return quality.with_host_verdict(judged, "host").filter("kept").select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that with the least doc_id.

    Of several rows with one doc_id that with the least text (of equal texts the least other columns) stands for all,
    before components are sought. Rows without an id stay, as do those without words: they are linked with nothing.
    """
    small_batches(spark)

    def few(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids

    again = materialize(docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    if not again.isEmpty():
        least = docs.join(few(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(_row(docs, ("text",))).alias("row"))
        docs = materialize(docs.join(few(again), "doc_id", "left_anti").select(*docs.columns).unionByName(least.select("row.*")), "one-each")
    found = jaccard.jaccard_components(docs)
    gone = materialize(found.filter("component_id <> doc_id").select("doc_id"), "near-copies")
    return docs.join(few(gone), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences; texts that are null or empty have their end id alone."""
    small_batches(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("packing", pack),
]

#: Language models and packing are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
