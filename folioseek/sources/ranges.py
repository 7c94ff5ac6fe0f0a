"""Records that reach over lines, cut by many tasks.

A file is scanned in byte ranges, each a run of short pieces between separators.  Whether a piece
ends a record depends on all text before it, but only through a small state (inside quotes or not, nesting
depth).  Each range tells how it changes the state, whatever it starts from; these changes, one row per range,
are added up along each file, and then every range knows its own start.  Texts are shuffled once, by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged

RANGE = ["file", "block"]


def _before():
    """Earlier pieces of a range."""
    return Window.partitionBy(*RANGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def _up_to():
    """Earlier pieces of a range and this one."""
    return Window.partitionBy(*RANGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _ranges_before():
    """Earlier ranges of a file."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def pieces(spark: SparkSession, path, separator: str) -> DataFrame:
    """``(file, at, block, pos, value)``: the texts between separators, in order of block and pos."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", separator).text(path).select(
        meta["file_path"].alias("file"),
        F.unix_micros(meta["file_modification_time"]).alias("at"),
        meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def _sum(what: Column, window) -> Column:
    return F.coalesce(F.sum(what).over(window), F.lit(0).cast("bigint"))


def json_ends(texts: DataFrame) -> DataFrame:
    """Pieces between ``}`` with ``ends``: that bracket closes an object that is an element of the file's array.

    No escape reaches over a separator: a backslash before it would take it as its own character.  A bracket is
    also counted after a file's last piece, where none may stand.
    """
    bare = F.regexp_replace("value", r"\\[\s\S]?", "")
    quoted = r'"[^"]*(?:"|\z)'
    odd = (F.length(bare) - F.length(F.translate(bare, '"', ""))) % 2

    def depth(text: Column, open_end: Column) -> Column:
        outside = F.regexp_replace(text, quoted, "")
        size = F.length(outside)
        opened, closed = size - F.length(F.translate(outside, "{[", "")), size - F.length(F.translate(outside, "]", ""))
        return (opened - closed - F.when(open_end, 0).otherwise(1)).cast("bigint")

    measured = texts.withColumns({"odd": odd.cast("bigint"), "d0": depth(bare, odd == 1), "d1": depth(F.concat(F.lit('"'), bare), odd == 0)})
    measured = measured.repartition(*RANGE).withColumn("flip", _sum(F.col("odd"), _before()) % 2)
    out = measured.withColumns({
        "c0": F.when(F.col("flip") == 0, F.col("d0")).otherwise(F.col("d1")),
        "c1": F.when(F.col("flip") == 0, F.col("d1")).otherwise(F.col("d0")),
    })
    change = out.groupBy(*RANGE).agg(F.sum("odd").alias("odd"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    change = change.withColumn("inside", _sum(F.col("odd"), _ranges_before()) % 2)
    change = change.withColumn("depth", _sum(F.when(F.col("inside") == 0, F.col("c0")).otherwise(F.col("c1")), _ranges_before()))
    known = out.join(change.select(*RANGE, "inside", "depth"), RANGE)
    now = F.col("depth") + _sum(F.when(F.col("inside") == 0, F.col("c0")).otherwise(F.col("c1")), _up_to())
    outside = (F.col("inside") + F.col("flip") + F.col("odd")) % 2 == 0
    return known.select(*RANGE, "at", "pos", "value", (outside & (now == 1)).alias("ends"))


def csv_lines(texts: DataFrame) -> DataFrame:
    """Lines with ``from0`` and ``from1``, whether a quoted cell is open after the line if none, or one, was before, and ``blank``.

    A quote opens a cell only at its start; elsewhere in a bare cell it is a character like any other.  Lines without quotes
    leave things as they are.  Written down, so that texts are looked at once and cuts stay as they are.
    """
    body = r'"[^"]*+(?:""[^"]*+)*+'
    line = F.regexp_replace("value", r"\r\z", "")
    quoted = F.contains("value", F.lit('"'))

    def left_open(text: Column) -> Column:
        rest = F.regexp_replace(text, rf'(?<=\A|,){body}"(?=,|\z)', "x")
        return rest.rlike(rf"(?:\A|,){body}\z").cast("int")

    return staged(
        texts.withColumns({
            "from0": F.when(quoted, left_open(line)).otherwise(0),
            "from1": F.when(quoted, left_open(F.concat(F.lit('"'), line))).otherwise(1),
            "blank": ~quoted & F.col("value").rlike(r"\A\s*\z"),
        }),
        "lines",
    )


def _csv_state(lines: DataFrame) -> DataFrame:
    """Lines, each range in one task, with what they and those before them in the range do to the state."""
    # A line sets the state, keeps it, or turns it round.
    turns = _sum(((F.col("from0") == 1) & (F.col("from1") == 0)).cast("bigint"), _up_to())
    turned = lines.repartition(*RANGE).withColumn("turns", turns)
    fixed = F.last(F.when(F.col("from0") == F.col("from1"), F.struct(F.col("from0").alias("to"), "turns")), ignorenulls=True).over(_up_to())
    return turned.withColumn("fixed", fixed)


def _csv_after(start: Column) -> Column:
    return (F.coalesce(F.col("fixed.to"), start) + F.col("turns") - F.coalesce(F.col("fixed.turns"), F.lit(0))) % 2


def _csv_ends(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """``ends``: the line break after a line is not inside a quoted cell.  ``nth``: records of its range that end before it."""
    known = _csv_state(lines).join(F.broadcast(starts), RANGE)
    ended = known.withColumn("ends", _csv_after(F.col("start")) == 0)
    return ended.withColumn("nth", _sum(F.col("ends").cast("bigint"), _before()))


def csv_ranges(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From written lines, without their texts: a row ``(file, block, start, n, first)`` per range, and the text of each file's header.

    ``start`` is the state a range begins in, ``n`` the records that end in it, ``first`` those that end before it.  The header
    ``(file, head_at, head)`` is the first record that is not blank.  It begins with the first line that is not, as blank lines outside
    quotes are records of their own.
    """
    slim = lines.select(*RANGE, "pos", "from0", "from1", "blank")
    change = _csv_state(slim).groupBy(*RANGE).agg(F.max_by(F.struct("fixed", "turns"), "pos").alias("c")).select(*RANGE, "c.fixed", "c.turns")
    along = change.withColumn("all_turns", _sum(F.col("turns"), _ranges_before()))
    # The last range before that fixes the state: what it ends in, and the turns up to its end.
    end = F.when(F.col("fixed").isNotNull(), F.struct(_csv_after(F.lit(0)).alias("to"), (F.col("all_turns") + F.col("turns")).alias("turns")))
    along = along.withColumn("from", F.last(end, ignorenulls=True).over(_ranges_before()))
    start = (F.coalesce(F.col("from.to"), F.lit(0)) + F.col("all_turns") - F.coalesce(F.col("from.turns"), F.lit(0))) % 2
    starts = staged(along.select(*RANGE, start.alias("start")), "starts")

    ended = _csv_ends(slim, starts)
    shown, ends = ~F.col("blank"), F.col("ends")
    per = ended.groupBy(*RANGE).agg(
        F.sum(ends.cast("bigint")).alias("n"),
        F.min(F.when(shown, F.col("pos"))).alias("shown"),
        F.min(F.when(shown, F.col("nth"))).alias("shown_nth"),
    )
    per = staged(per.join(starts, RANGE).withColumn("first", _sum(F.col("n"), _ranges_before())), "ranges")
    heads = per.filter("shown IS NOT NULL").groupBy("file").agg(F.min(F.struct("block", "shown", (F.col("first") + F.col("shown_nth")).alias("at"))).alias("h"))
    heads = heads.select("file", F.col("h.block").alias("from_block"), F.col("h.shown").alias("shown_at"), F.col("h.at").alias("head_at"))
    # Ranges that hold lines of the header; of those, the lines from its first to its last.
    held = per.select(*RANGE, "n", "first").join(heads, "file").filter("block >= from_block AND first <= head_at AND first + n >= head_at")
    inside = ended.select(*RANGE, "pos", "nth").join(F.broadcast(held), RANGE).filter((F.col("first") + F.col("nth") == F.col("head_at")) & ((F.col("block") > F.col("from_block")) | (F.col("pos") >= F.col("shown_at"))))
    spans = staged(inside.groupBy(*RANGE).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("head_at").alias("head_at")), "header-lines")
    texts = lines.select(*RANGE, "pos", "value").join(F.broadcast(spans), RANGE).filter("pos BETWEEN lo AND hi")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "pos", "value"))), lambda p: p["value"]), "\n")
    headers = texts.groupBy("file").agg(F.max("head_at").alias("head_at"), F.regexp_replace(text, r"\r\z", "").alias("head"))
    return per.select(*RANGE, "start", "n", "first"), headers


def csv_records(lines: DataFrame, per: DataFrame) -> DataFrame:
    """``(file, at, record, text, ended)`` of written lines and their ranges, as :func:`records`; texts are shuffled once, by range."""
    return _joined(_csv_ends(lines, per.select(*RANGE, "start")), F.broadcast(per.select(*RANGE, "n", "first")), "\n")


def records(ended: DataFrame, separator: str) -> DataFrame:
    """``(file, at, record, text, ended)``: pieces joined up to one that ends, numbered from 0 in each file.

    Records inside a range stay where they are; only the first and last of each range are shuffled again.
    What follows a file's last end is a record that has not ended.
    """
    one = F.col("ends").cast("bigint")
    counted = ended.withColumn("nth", _sum(one, _before()))
    counts = counted.groupBy(*RANGE).agg(F.sum(one).alias("n"))
    counts = counts.select(*RANGE, "n", _sum(F.col("n"), _ranges_before()).alias("first"))
    return _joined(counted, counts, separator)


def _joined(counted: DataFrame, counts: DataFrame, separator: str) -> DataFrame:
    part = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"]), separator)
    parts = (
        counted.groupBy(*RANGE, "nth").agg(F.max("at").alias("at"), part.alias("text"), F.max("ends").alias("ended"))
        .join(counts, RANGE)
        .withColumn("record", F.col("first") + F.col("nth"))
    )
    inner = (F.col("nth") > 0) & (F.col("nth") < F.col("n"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), separator)
    edges = parts.filter(~inner).groupBy("file", "record").agg(F.max("at").alias("at"), whole.alias("text"), F.max("ended").alias("ended"))
    columns = ["file", "at", "record", "text", "ended"]
    return parts.filter(inner).select(*columns).unionByName(edges.select(*columns))
