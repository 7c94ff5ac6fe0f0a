"""Session-level helpers: shared scratch space, checkpoints, input spreading."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only for a local-mode session."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="folioseek-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The lineage ends there: a lost executor costs no rerun of what came before, and values
    that depend on the partitioning are fixed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small input enough partitions to keep every core busy.

    A file with one row group is one task however costly its rows are.  The shuffle is
    added only where the whole input is smaller than one scan split per core; beyond
    that the scan is already parallel and the frame is returned unchanged.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if estimated_bytes(df) < cores * split:
        return df.repartition(cores, *keys)
    return df


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks, whatever files they lie in: a Parquet file of one row group is read by one task, however large.

    By running number, as a key may be hot and dealing without one sorts the rows; adaptive execution joins small shares.
    """
    return df.withColumn("_at", F.monotonically_increasing_id()).repartition("_at").drop("_at")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """While a frame with whole texts is written: fewer rows at once between Spark and its Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def local_session(cores: str = "8", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and trials; on a cluster use the one it provides."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioseek")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
