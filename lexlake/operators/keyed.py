"""Tables of keyed rows that are changed in batches: what a batch writes grows with the batch, and a version appears as a whole.

A table is a folder of Parquet written by Spark. Rows lie in buckets of their key; a batch adds a layer of its own rows to
the buckets it touches, and a bucket whose layers have grown to a share of it is laid down anew. A version is a list of what to
read for each bucket, written in one file at the end: readers see all of a batch or nothing of it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexlake.operators.versions import upsert

_LIST = "version long, bucket int, place string, n long, is_base boolean, batch string"
#: Layers of a bucket are laid down anew when they hold this share of its rows.
SHARE = 0.5


class KeyedTable:
    """A table at a path that all executors see. key names a row; of several rows of a key the one of largest order counts, of equal ones the last laid.

    There may be one writer at a time, as in foreachBatch; readers need no lock. Files of versions before are kept.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", order: str = "seq", buckets: int = 32):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _lists(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_LIST).parquet(f"{self.path}/versions/*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def version(self) -> int | None:
        """The newest whole version; None before the first batch."""
        lists = self._lists()
        return None if lists is None else lists.agg(F.max("version")).first()[0]

    def _parts(self, version: int | None) -> list:
        """(bucket, place, n, is_base, batch) of a version, at most some layers a bucket."""
        lists = self._lists()
        return [] if lists is None or version is None else lists.filter(F.col("version") == version).collect()

    def _rows(self, parts: list[tuple[int, str]]) -> DataFrame:
        """The winning row of each key in (bucket, place)s, with the layer that it came with."""
        held = self.spark.read.parquet(*sorted({f"{self.path}/rows/{place}/__bucket={bucket}" for bucket, place in parts}))
        order = W.partitionBy(self.key).orderBy(F.col(self.order).desc_nulls_last(), F.col("__layer").desc())
        return held.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        parts = self._parts(self.version() if version is None else version)
        if not parts:
            raise ValueError(f"{self.path} has no such version")
        return self._rows([(p.bucket, p.place) for p in parts if p.bucket >= 0]).drop("__layer")

    def _write(self, rows: DataFrame, place: str) -> dict[int, int]:
        """Write rows by bucket; how many there are in each."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/rows/{place}")
        written = self.spark.read.schema(rows.select("__layer").withColumn("__bucket", F.lit(0)).schema).parquet(f"{self.path}/rows/{place}")
        return {r["__bucket"]: r.n for r in written.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).collect()}

    def lay(self, changes: DataFrame, batch: int | str) -> int:
        """Lay a batch over the table; its version. A batch that is in it already changes nothing and gives the newest version.

        A batch that failed on the way has no version; laid again it writes the same places anew.
        """
        now = self.version()
        done = self._lists()
        if done is not None and not done.filter(F.col("batch") == str(batch)).isEmpty():
            return now
        new, parts = (0 if now is None else now + 1), self._parts(now)
        rows = upsert(changes.limit(0), changes, self.key, self.order).withColumn("__layer", F.lit(new).cast("long"))
        place = f"v{new}"
        parts = [(p.bucket, p.place, p.n, p.is_base) for p in parts] + [(b, place, n, False) for b, n in self._write(rows, place).items()]
        grown = []
        for b in {p[0] for p in parts}:
            base, layers = (sum(p[2] for p in parts if p[0] == b and p[3] == kind) for kind in (True, False))
            if layers > SHARE * base:
                grown.append(b)
        # A bucket's first layer is its base; others are laid down anew when their layers have grown.
        first = [b for b in grown if not any(p[0] == b and p[1] != place for p in parts)]
        parts = [(b, x, n, True) if b in first else (b, x, n, k) for b, x, n, k in parts]
        again = [b for b in grown if b not in first]
        if again:
            base = self._write(self._rows([(b, x) for b, x, _, _ in parts if b in again]), f"{place}-base")
            parts = [p for p in parts if p[0] not in again] + [(b, f"{place}-base", n, True) for b, n in base.items()]
        listed = [(new, *p, str(batch)) for p in parts] or [(new, -1, "", 0, True, str(batch))]
        self.spark.createDataFrame(listed, _LIST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/v={new}")
        return new


def with_active(versions: DataFrame, pointers: DataFrame) -> DataFrame:
    """versions with status and active by pointers (doc_id, version_id), the read of a KeyedTable by doc_id: the one pointed at is ACTIVE, others that were become READY.

    Which version of each document counts is one row of the pointers, and a batch of activations is one version of that table,
    so no reader sees a document with two active versions or none.
    """
    p = pointers.select("doc_id", F.col("version_id").alias("__p"))
    both = versions.join(p, "doc_id", "left")
    known = F.col("__p").isNotNull()
    status = F.when(F.col("version_id") == F.col("__p"), "ACTIVE").when(known & (F.col("status") == "ACTIVE"), "READY").otherwise(F.col("status"))
    return both.withColumn("status", status).withColumn("active", F.col("status") == "ACTIVE").drop("__p")
