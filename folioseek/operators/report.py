"""What became of each document of a batch, and of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(typed: DataFrame) -> DataFrame:
    """``(seq, docid, error)``: an id or an error text per input document.

    ``seq`` keeps the input order; sort by it where the order is shown.
    """
    return typed.select("seq", "docid", "error")


def batch_summary(typed: DataFrame, index: str) -> DataFrame:
    """One row: documents added and a code.

    500 if a document could not be converted; documents the reader could not read do not
    count.
    """
    failed = F.count_if(F.col("stage") == "convert")
    return typed.agg(
        F.count_if(F.col("error").isNull()).alias("docs"),
        F.count_if(F.col("stage") == "read").alias("unreadable"),
        failed.alias("failed"),
    ).select(
        F.lit(index).alias("index"),
        "docs",
        "unreadable",
        "failed",
        F.when(F.col("failed") > 0, 500).otherwise(200).alias("code"),
        F.when(F.col("failed") > 0, "some documents were rejected").otherwise("OK").alias("msg"),
    )
