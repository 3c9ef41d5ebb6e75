"""Shared storage for intermediate tables.

Anything that a later job must find again goes to the folder that the cluster names in
``spark.checkpoint.dir``: every executor and the driver see it, so a lost executor loses nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side of a join may be broadcast up to this many rows of a few fixed-width columns.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch that goes to Python, where the session allows more.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where none is set (tests, local mode)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lexlake-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/lexlake/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, drop_shuffles: bool = False, held: list[str] | None = None) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage and survives lost executors.

    drop_shuffles: what was shuffled for it goes from the executors' disks as soon as it is written. held: gets the
    table's path, for discard().
    """
    path = scratch_path(df.sparkSession, name)
    if held is not None:
        held.append(path)
    conf, clean = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(clean, "false")
    if drop_shuffles:
        conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(clean, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, held: list[str]) -> None:
    """Delete tables that materialize has written and that no later job reads."""
    for path in held:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    held.clear()


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt to all cores if it has fewer splits than these: texts cost far more to work on than to move. Larger inputs stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES: texts are long, so a bound on rows alone is none on memory.

    A lower bound that the session has set stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
