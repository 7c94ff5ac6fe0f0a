"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioseek.session import small_batches, staged  # noqa: F401

FILE, ROW = "__file", "__row"
WORD = r"[^\x20\x09-\x0D]+"
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, **columns: Column) -> DataFrame:
    """The named columns with a key of each row: its file and its place in that file.

    The key lets rows that are equal in every column be told apart, and stays the same
    however often the table is read.  A frame that is no plain scan is written first.
    """
    key = [F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)]
    wanted = [c.alias(n) for n, c in columns.items()]
    try:
        out = df.select(*key, *wanted)
        out.schema
        return out
    except AnalysisException:
        plain = staged(df.select(*wanted), "rows")
        return plain.select(*key, *(F.col(n) for n in columns))


def as_scan(df: DataFrame) -> DataFrame:
    """The frame itself if its rows can be keyed by file and place, else the same rows written and read again."""
    try:
        df.select("_metadata.row_index").schema
        return df
    except AnalysisException:
        return staged(df, "rows")


def with_row_key(scan: DataFrame) -> DataFrame:
    """All columns of a scan and the row key that ``numbered`` gives the same rows."""
    return scan.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def rows_left(scan: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a scan whose keys are not among ``dropped``; few keys are broadcast, so texts stay where they are."""
    dropped = staged(dropped.select(FILE, ROW), "dropped")
    return with_row_key(scan).join(maybe_broadcast(dropped, dropped.count()), [FILE, ROW], "left_anti").select(*scan.columns)


def integer_names(distinct: DataFrame, *cols: str) -> DataFrame:
    """Give each row of a table of distinct keys an integer over 0: its place in sorted order.

    Keys are dealt to buckets by hash and sorted inside each; a name is bucket and place.
    No key repeats, so buckets are even.
    """
    spark = distinct.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("__bucket").orderBy(*cols)
    return (
        distinct.withColumn("__bucket", F.pmod(F.xxhash64(*cols), F.lit(buckets)))
        .withColumn("name", F.col("__bucket") * F.lit(1 << 40) + F.row_number().over(w))
        .drop("__bucket")
    )


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def held_out(doc_id: Column | str) -> Column:
    """Rows never learned from: crc32 of the id as text has remainder 2 by 4."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def text_bytes_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def maybe_broadcast(df: DataFrame, rows: int, limit: int = 50_000) -> DataFrame:
    """Mark a counted frame of short rows for broadcast if it is small; else leave it to the planner."""
    return F.broadcast(df) if rows <= limit else df
