"""From raw documents to padded training batches: language, exact and near dedup, mixing, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last one
returns the batch plan.  Stages are written as Parquet and read again, so a lost executor costs
no more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioseek.llm.common import FILE, ROW, as_scan, rows_left, table, with_row_key
from folioseek.llm.exact_dedup import exact_dedup
from folioseek.llm.language import fit_languages, predict_languages
from folioseek.llm.mixing import mix_sources
from folioseek.llm.near_dedup import near_duplicates
from folioseek.llm.packing import pack_by_length
from folioseek.session import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those without letters go, and those whose code no learned language comes near.

    Where no document has a language to learn from, all with letters stay.
    """
    docs = as_scan(docs)
    return rows_left(docs, predict_languages(docs, fit_languages(docs)).filter("rejected"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    docs = as_scan(docs)
    return rows_left(docs, exact_dedup(docs).filter("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more."""
    docs = as_scan(docs)
    return rows_left(docs, near_duplicates(docs).filter("NOT kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    docs = as_scan(docs)
    taken = mix_sources(docs).filter("copies > 0").select(FILE, ROW, "copies")
    return with_row_key(docs).join(taken, [FILE, ROW]).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and place of every document."""
    return pack_by_length(docs)


STAGES = [("language", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("packing", packing)]
#: A trained language model decides the first stage: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
