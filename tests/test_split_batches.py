"""Splitters hand on batches of bounded size, and hold no more."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexlake.operators import split
from lexlake.storage import BATCH_BYTES


@pytest.mark.parametrize(("strategy", "options"), [("separator", {"separator": "\n"}), ("heading", {}), ("fixed", {})])
def test_chunks_come_in_small_batches(spark, monkeypatch, strategy, options):
    """40 texts of 500 KB in one task: all their chunks were one batch of 20 MB."""
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("# words of a line\nand more of it. \n"), 15_000).alias("text"))
    chunks = split.split_documents(docs, strategy, 200, **options)

    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= BATCH_BYTES
    texts = docs.limit(8).collect()
    # The task's own function, without Spark around it.
    held = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: held.setdefault("f", f))
    split.split_documents(docs, strategy, 200, **options)
    batch = pa.RecordBatch.from_arrays([pa.array([r.doc_id for r in texts]), pa.array([r.text for r in texts])], names=["doc_id", "text"])
    got = [b.nbytes for b in held["f"](iter([batch]))]
    assert len(got) > 1 and max(got) <= 2 * split.HELD_BYTES
    monkeypatch.undo()
    assert chunks.groupBy("doc_id").count().select("count").distinct().count() == 1
