"""Continuous ingest: each micro-batch becomes one batch of the collection."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.collection import Collection
from ..session import dealt
from ..sources.readers import from_table, parse_json_lines


def json_lines_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select("value", F.col("_metadata").alias("meta"))


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the stream when it made the checkpoint."""
    return json.loads(spark.read.text(os.path.join(checkpoint, "metadata")).first().value)["id"]


def ingest(
    stream: DataFrame,
    collection: Collection,
    checkpoint: str,
    seq: str | None = None,
    on_batch=None,
    available_now: bool = False,
    name: str | None = None,
) -> StreamingQuery:
    """Upsert a stream into a collection, last write wins.

    A stream with ``value`` and ``meta`` is read as JSON Lines, any other as rows whose
    versions ``seq`` orders.  A micro-batch takes the collection's next number; its source is the
    stream's own id, which its checkpoint keeps over restarts, and the micro-batch's number.  So a
    batch repeated after a failure changes nothing, and other streams, new checkpoints and batches added
    by hand never collide with it.  ``name`` stands in for the stream's id where a lost checkpoint is to be
    replayed: the same name and number are then the same batch.  Once a batch is complete, ``on_batch`` gets its summary row as a frame.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        source = f"{name or _stream_id(rows.sparkSession, checkpoint)}/{batch_id}"
        if set(rows.columns) == {"value", "meta"}:
            docs = parse_json_lines(rows, F.monotonically_increasing_id())
        else:
            docs = dealt(from_table(rows, seq))
        collection.append(docs, source=source)
        if on_batch is not None:
            on_batch(collection.summaries().filter(F.col("source") == source))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
