"""Pages for queries that only exclude.

Such a query returns nearly every document, so its result is never spelled out.  The
documents are put in result order once; what a query excludes is one bitmap for each block of
positions.  A frequent token's bitmaps are made once and shared by all queries that exclude it; rare
tokens add single positions.  Bits set tell how many survivors stand before each block and so in which
blocks the page falls; only those are read bit by bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .paging import Page

#: Positions of a block; Spark's bitmaps have room for this many.
BLOCK = 32_768
#: Positions read bit by bit at once: a block's bitmap is counted in such pieces first.
PIECE = 512
#: A token with fewer documents than this in a block, on average, has no bitmaps of its own.
DENSE = 64
_ROW_BITS = (1 << 33) - 1


def positions(docs: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``(docid, pos)``: 0-based place of each document in the given total order.

    A range shuffle sorts; partition number and row number are written down with the rows,
    and the sizes of the earlier partitions are added.
    """
    placed = docs.orderBy(*order).select(
        "docid",
        F.spark_partition_id().alias("pid"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("row"),
    )
    fixed = staged(placed, "positions")
    # One row per partition: small whatever the data.
    before = fixed.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).select(
        "pid",
        (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"),
    )
    return fixed.join(before, "pid").select("docid", (F.col("before") + F.col("row")).alias("pos"))


def _bits(df: DataFrame, *keys: str) -> DataFrame:
    """``(keys, block, bits)`` of rows ``(keys, pos)``; equal positions are one bit."""
    block = F.floor(F.col("pos") / BLOCK).cast("bigint").alias("block")
    return df.groupBy(*keys, block).agg(F.bitmap_construct_agg(F.pmod("pos", F.lit(BLOCK)).cast("bigint")).alias("bits"))


def excluded_bits(barring: DataFrame, posted: DataFrame, placed: DataFrame, n_docs: int, few: bool) -> DataFrame:
    """``(qid, block, bits, n)`` of what queries exclude: ``barring`` is ``(qid, scope, token, df)``, written down.

    A posting is met once, not once per query, if its token is frequent; ``few`` says that ``barring`` can be broadcast.
    """
    near = F.broadcast if few else lambda df: df
    barring = barring.filter("df > 0")
    frequent = F.col("df") * BLOCK >= DENSE * n_docs
    posted = posted.select("scope", "token", "docid")
    dense, sparse = barring.filter(frequent), barring.filter(~frequent)
    shared = posted.join(near(dense.select("scope", "token").distinct()), ["scope", "token"], "left_semi").join(placed, "docid")
    by_token = _bits(shared, "scope", "token").join(near(dense.select("qid", "scope", "token")), ["scope", "token"])
    single = posted.join(near(sparse.select("qid", "scope", "token")), ["scope", "token"]).join(placed, "docid")
    both = by_token.select("qid", "block", "bits").unionByName(_bits(single, "qid").select("qid", "block", "bits"))
    return both.groupBy("qid", "block").agg(F.bitmap_or_agg("bits").alias("bits")).withColumn("n", F.bitmap_count("bits"))


def _free(bits: Column, size: int) -> Column:
    """Places 0, 1, ... of the first ``size`` bits that are not set, in order."""

    def of_byte(i: Column) -> Column:
        byte = F.conv(F.hex(F.call_function("substring", bits, i + 1, F.lit(1))), 16, 10).cast("int")
        unset = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.call_function("shiftright", byte, b) % 2 == 0)
        return F.transform(unset, lambda b: i * 8 + b)

    places = F.flatten(F.transform(F.sequence(F.lit(0), F.lit((size - 1) // 8)), of_byte))
    return places if size % 8 == 0 else F.filter(places, lambda i: i < size)


def surviving_page(counts: DataFrame, placed: DataFrame, page: Page) -> DataFrame:
    """``(qid, docid, rank)`` of the page for each query with ``counts`` (qid, block, bits, n) of what it excludes."""
    in_order = Window.partitionBy("qid").orderBy("block")
    blocks = (
        counts.select(
            "qid",
            "block",
            F.sum("n").over(in_order).alias("gone"),
            F.col("n"),
            F.lag("block").over(in_order).isNull().alias("is_first"),
            F.lead("block").over(in_order).alias("next"),
        )
        .select(
            "qid",
            "block",
            "gone",
            "is_first",
            # Survivors before the block, before the gap after it, before the next block.
            (F.col("block") * BLOCK - (F.col("gone") - F.col("n"))).alias("at_block"),
            ((F.col("block") + 1) * BLOCK - F.col("gone")).alias("at_gap"),
            F.coalesce(F.col("next") * BLOCK - F.col("gone"), F.lit(1 << 62)).alias("at_next"),
        )
    )

    def stretch(low: Column, high: Column, shift: Column) -> DataFrame:
        """Survivors low..high-1 (those on the page) stand at their number plus ``shift``."""
        low, high = F.greatest(low, F.lit(page.offset)), F.least(high, F.lit(page.end))
        return (
            blocks.filter(low < high)
            .select("qid", F.explode(F.sequence(low, high - 1)).alias("k"), shift.alias("shift"))
            .select("qid", "k", (F.col("k") + F.col("shift")).alias("pos"))
        )

    head = stretch(
        F.lit(0).cast("bigint"),
        F.when(F.col("is_first"), F.col("block") * BLOCK).otherwise(F.lit(0)),
        F.lit(0).cast("bigint"),
    )
    gaps = stretch(F.col("at_gap"), F.col("at_next"), F.col("gone"))

    # Blocks with survivors on the page: at most page size + 1 per query.
    touched = blocks.filter(
        (F.col("at_block") < page.end) & (F.col("at_gap") > page.offset) & (F.col("at_gap") > F.col("at_block"))
    ).select("qid", "block", "at_block")
    first = F.col("block") * BLOCK
    size = min(PIECE, BLOCK)
    piece = lambda i: F.call_function("substring", F.col("bits"), i * (size // 8) + 1, F.lit(-(-size // 8)))
    cut = F.transform(F.sequence(F.lit(0), F.lit(BLOCK // size - 1)), piece)
    ahead = Window.partitionBy("qid", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        touched.join(counts.select("qid", "block", "bits"), ["qid", "block"])
        .select("qid", "block", "at_block", first.alias("first"), F.posexplode(cut).alias("no", "part"))
        .withColumn("free", size - F.bitmap_count("part"))
        .withColumn("at", F.col("at_block") + F.coalesce(F.sum("free").over(ahead), F.lit(0)))
        .filter((F.col("at") < page.end) & (F.col("at") + F.col("free") > page.offset))
    )
    inside = (
        pieces.select("qid", "at", (F.col("first") + F.col("no") * size).alias("first"), F.posexplode(_free(F.col("part"), size)).alias("i", "place"))
        .select("qid", (F.col("at") + F.col("i")).alias("k"), (F.col("first") + F.col("place")).alias("pos"))
        .filter((F.col("k") >= page.offset) & (F.col("k") < page.end))
    )
    return (
        head.unionByName(gaps)
        .unionByName(inside)
        .join(placed, "pos")
        .select("qid", "docid", (F.col("k") + 1).alias("rank"))
    )
