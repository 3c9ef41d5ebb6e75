"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.storage import small_batches, spread
from lexlake.storage import table as stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(stored(spark, sf_dir, name))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowing fingerprints of all documents and of their edited texts."""
    from lexlake.llm.fingerprints import edit_likeness

    return edit_likeness(table(spark, sf_dir, "documents"))


def op2_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records in ZIP packages and read them back by range."""
    from lexlake.llm.warc import archive_round_trip

    return archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens."""
    from lexlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op4_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs by rules and boosted trees."""
    from lexlake.llm.url_filter import filter_urls, label_pages

    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, label_pages(pages))


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles are alike to 0.8 or more."""
    from lexlake.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by class-conditional language models."""
    from lexlake.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents by prefix dynamic programming and decode them."""
    from lexlake.llm.bpe import bpe_round_trip

    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on all documents, with verdicts of their hosts."""
    from lexlake.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op9_language_bitmask_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, by filters that two thirds of them have taught."""
    from lexlake.llm.language import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


def op10_bit_plane_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write bit-plane token files in order of doc_id and read them back."""
    from lexlake.llm.token_files import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, manifest).withColumnRenamed("key", "doc_id")


def op11_crc_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weigh all documents by the benchmark's words and draw a tenth of those long enough."""
    from lexlake.llm.resampling import importance_resampling

    return importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_norm_bucketed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for each vector whose id is divisible by 20."""
    from lexlake.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op13_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives among all vectors for those whose id is divisible by 50, with every seventh label set off by one."""
    from lexlake.llm.negatives import hard_negatives

    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


_ALL = (
    op1_winnowing_fingerprints, op2_warc_packages, op3_harmonic_packing, op4_url_trees, op5_jaccard_components, op6_kneser_ney_toxicity, op7_prefix_bpe, op8_host_quality_rules,
    op9_language_bitmask_filters, op10_bit_plane_token_files, op11_crc_importance_resampling, op12_norm_bucketed_top_k, op13_cover_tree_negatives,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    from lexlake.llm import sql

    return {
        "op2_warc_packages": sql.WARC, "op8_host_quality_rules": sql.QUALITY, "op11_crc_importance_resampling": sql.RESAMPLING,
        "op12_norm_bucketed_top_k": sql.TOP_K, "op13_cover_tree_negatives": sql.NEGATIVES,
    }
