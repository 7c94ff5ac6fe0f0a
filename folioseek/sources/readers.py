"""Readers for document sources.

Each reader gives the same three columns:

``seq``      where the document stands in its source (file time, path, block, position);
``payload``  the raw document, a VARIANT (JSON) or a STRUCT of columns (CSV, tables);
``error``    why the document could not be read, else NULL.

A batch number is put in front of ``seq`` when documents enter a collection.
"""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import let
from ..session import staged
from . import ranges

# Formats by file extension and by MIME type.
BY_EXTENSION = {".csv": "csv", ".jsonl": "jsonl", ".json": "json"}
BY_MIME = {"application/json": "json", "text/csv": "csv", "application/x-ndjson": "jsonl"}

_CORRUPT = "_corrupt_row"
_BLANK = r"\A\s*\z"
_JSON_SPACE = " \t\r\n"


def _seq(at: Column, source: Column, block: Column, pos: Column) -> Column:
    return F.struct(
        at.cast("bigint").alias("at"),
        source.alias("source"),
        block.cast("bigint").alias("block"),
        pos.cast("bigint").alias("pos"),
    ).alias("seq")


def _file_seq(meta: Column, pos: Column) -> Column:
    return _seq(
        F.unix_micros(meta["file_modification_time"]),
        meta["file_path"],
        meta["file_block_start"],
        pos,
    )


def parse_json_lines(lines: DataFrame, pos: Column) -> DataFrame:
    """Rows of ``value`` (one JSON text each) and ``meta`` (the file's metadata).

    A line that is no JSON becomes an error row; the lines after it are kept.
    """
    parsed = lines.select(_file_seq(F.col("meta"), pos), "value").filter(
        ~F.col("value").rlike(_BLANK)
    )
    return parsed.select(
        "seq", "value", F.try_parse_json("value").alias("payload")
    ).select(
        "seq",
        "payload",
        F.when(F.col("payload").isNull(), F.concat(F.lit("not JSON: "), F.col("value"))).alias("error"),
    )


def read_json_lines(spark: SparkSession, path) -> DataFrame:
    """One JSON document per line; splittable, so the format to prefer for big inputs."""
    lines = spark.read.text(path).select("value", F.col("_metadata").alias("meta"))
    # Within a file block ids rise with the lines, and blocks are ordered by offset.
    return parse_json_lines(lines, F.monotonically_increasing_id())


def read_json_array(spark: SparkSession, path, on_bad_file: str = "fail") -> DataFrame:
    """Each file is one JSON array of objects (or nulls), read by many tasks whatever its size.

    An array is all or nothing: a file that is not an array of objects ends the job, or
    gives a single error row with ``on_bad_file="report"``.  Elements are cut out by ranges of bytes
    (``ranges.json_ends``) and parsed one by one, so Spark's limit on a VARIANT (128 MiB) holds for a
    document, not for the file.  Text without any closing brace is one piece.  Files of no bytes are not read.
    """
    if on_bad_file not in ("fail", "report"):
        raise ValueError(f"on_bad_file must be fail or report, not {on_bad_file}")
    cut = ranges.records(ranges.json_ends(ranges.pieces(spark, path, "}")), "}")
    # Nulls may stand before an object, or before the end; then nothing else does.
    opening = F.when(F.col("record") == 0, F.lit("[")).otherwise(F.lit(","))
    bare = F.ltrim("text", F.lit(_JSON_SPACE))
    between = F.regexp_extract(bare.substr(F.lit(2), F.length(bare)), r"\A[ \t\r\nnul,]*+", 0)
    follows = bare.substr(F.length(between) + 2, F.length(bare))
    closes = F.rtrim(follows, F.lit(_JSON_SPACE)) == "]"
    shaped = bare.startswith(opening) & F.when(F.col("ended"), follows.startswith("{")).otherwise(closes)
    over = ~F.col("ended") & (F.col("record") > 0) & (F.rtrim(bare, F.lit(_JSON_SPACE)) == "]")
    body = F.concat(F.lit("["), bare.substr(F.lit(2), F.length(bare)), F.when(F.col("ended"), F.lit("}]")).otherwise(F.lit("")))
    docs = F.when(over, F.array().cast("array<variant>")).when(shaped, F.from_json(body, "array<variant>", {"allowSingleQuotes": "false"}))
    odd_one = F.exists("docs", lambda d: ~F.is_variant_null(d) & ~F.schema_of_variant(d).startswith("OBJECT"))
    # Only an array without elements may be empty; after a comma there must be one.
    empty = ~over & (F.col("record") > 0) & (F.size("docs") == 0)
    groups = cut.withColumns({"over": over, "docs": docs}).withColumn("bad", F.col("docs").isNull() | odd_one | empty)

    # A file must end after its array: in a piece that is not closed by a brace.
    size = cut.groupBy("file").agg(
        F.min("ended").alias("open_end"), (F.sum(F.octet_length("text")) + F.count(F.lit(1))).alias("with_brace")
    )
    if on_bad_file == "report":
        size = size.join(groups.groupBy("file").agg(F.max("bad").alias("bad")), "file")
    else:
        size = size.withColumn("bad", F.lit(False))
    meta = F.col("_metadata")
    files = spark.read.format("binaryFile").load(path).select(
        meta["file_path"].alias("file"), F.unix_micros(meta["file_modification_time"]).alias("at"), meta["file_size"].alias("size")
    )
    packed = F.col("file").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)\z")
    braced = ~packed & F.col("with_brace").isin(F.col("size"), F.col("size") - 3)  # three bytes of a byte order mark are not read
    failed = files.join(size, "file", "left").filter(F.col("with_brace").isNull() | F.col("open_end") | F.col("bad") | braced).select("file", "at")

    message = F.concat(F.lit("not a JSON array of objects: "), F.col("file"))
    nothing, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    refuse = F.raise_error(message).cast("array<variant>")
    if on_bad_file == "fail":
        kept, checked = groups, F.when(F.col("bad"), refuse).otherwise(F.col("docs"))
        told = failed.select("file", "at", nothing.alias("record"), none.alias("error"), F.posexplode(refuse).alias("pos", "payload"))
    else:
        kept, checked = groups.join(failed.select("file"), "file", "left_anti"), F.col("docs")
        told = failed.select("file", "at", nothing.alias("record"), message.alias("error"), F.lit(0).alias("pos"), F.lit(None).cast("variant").alias("payload"))
    rows = kept.select("file", "at", "record", none.alias("error"), F.posexplode(checked).alias("pos", "payload"))
    return rows.unionByName(told).select(_seq(F.col("at"), F.col("file"), F.col("record"), F.col("pos")), "payload", "error")


def _header_names(text: str) -> list[str]:
    cells = next(csv.reader(io.StringIO(text, newline="")), [])
    lower = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if lower.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_csv(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """CSV with a header in each file; every cell is a string, an empty cell is ``""``.

    Columns go by name: files may have them in another order, or other ones, and a column that a file lacks
    is NULL.  Line breaks inside quotes are kept; files are cut by ranges of bytes (``ranges.csv_lines``), so a file is
    read by many tasks.  Lines are written down first; headers are found from them, one row per file.
    A row with too few or too many cells becomes an error row and reading goes on; a quote that is never
    closed takes the rest of its file into its record.

    ``multiline=False`` forbids line breaks inside quotes, wants one header for all files and needs no pass or shuffle.
    """
    if multiline:
        return _read_csv_ranges(spark, path)
    options = {"header": True, "escape": '"', "mode": "PERMISSIVE"}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in names] + [T.StructField(_CORRUPT, T.StringType())]
    )
    rows = (
        spark.read.options(
            **options, columnNameOfCorruptRecord=_CORRUPT, enforceSchema=False, emptyValue=""
        )
        .schema(schema)
        .csv(path)
    )
    cells = F.struct(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])
    bad = F.col(_CORRUPT).isNotNull()
    return rows.select(
        _file_seq(F.col("_metadata"), F.monotonically_increasing_id()),
        F.when(~bad, cells).alias("payload"),
        F.when(bad, F.concat(F.lit("wrong number of cells: "), F.col(_CORRUPT))).alias("error"),
    )


def _read_csv_ranges(spark: SparkSession, path) -> DataFrame:
    lines = ranges.csv_lines(ranges.pieces(spark, path, "\n"))
    per, heads = ranges.csv_ranges(lines)
    rows = ranges.csv_records(lines, per)
    rows = rows.withColumn("text", F.regexp_replace("text", r"\r\z", "")).filter(~F.col("text").rlike(_BLANK))
    heads = staged(heads, "headers")
    # One entry per different header, however many files there are.
    headers = {r.head: _header_names(r.head) for r in heads.select("head").distinct().orderBy("head").collect()}
    if not headers:
        return rows.select(_seq(F.col("at"), F.col("file"), F.lit(0), F.lit(0)), F.lit(None).cast("struct<>").alias("payload"), F.lit(None).cast("string").alias("error"))
    names = list(dict.fromkeys(n for own in headers.values() for n in own))
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "emptyValue": ""}
    cells = None
    for head, own in headers.items():
        ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in [*own, _CORRUPT])
        found = F.from_csv("text", ddl, options)
        held = set(own)

        def kept(record: Column) -> Column:
            values = [F.coalesce(record.getField(n), F.lit("")) if n in held else F.lit(None).cast("string") for n in names]
            return F.struct(record.getField(_CORRUPT).isNotNull().alias("bad"), F.struct(*[v.alias(n) for v, n in zip(values, names)]).alias("cells"))

        one = let(found, kept)  # a record is parsed once, not once for each column
        cells = F.when(F.col("head") == head, one) if cells is None else cells.when(F.col("head") == head, one)
    read = rows.join(heads, "file").filter(F.col("record") > F.col("head_at"))
    read = read.select("at", "file", "record", "text", F.explode(F.array(cells)).alias("read"))
    bad = F.col("read.bad")
    return read.select(
        _seq(F.col("at"), F.col("file"), F.lit(0), F.col("record")),
        F.when(~bad, F.col("read.cells")).alias("payload"),
        F.when(bad, F.concat(F.lit("wrong number of cells: "), F.col("text"))).alias("error"),
    )


def from_table(df: DataFrame, seq: str | None = None) -> DataFrame:
    """Documents that are rows already; NULL means the field is absent.

    ``seq`` names the column that orders versions of one document.
    """
    pos = F.col(f"`{seq}`") if seq else F.monotonically_increasing_id()
    return df.select(
        _seq(F.lit(0), F.lit(""), F.lit(0), pos),
        F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("payload"),
        F.lit(None).cast("string").alias("error"),
    )


def format_of(path: str, fmt: str | None = None) -> str:
    """Format by name or MIME type, else by extension, else a JSON array."""
    if fmt in ("csv", "json", "jsonl"):
        return fmt
    if fmt:
        return BY_MIME.get(fmt.split(";")[0].strip().lower(), "json")
    return BY_EXTENSION.get(os.path.splitext(path)[1].lower(), "json")


def read(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    readers = {"csv": read_csv, "jsonl": read_json_lines, "json": read_json_array}
    return readers[format_of(path, fmt)](spark, path, **options)
