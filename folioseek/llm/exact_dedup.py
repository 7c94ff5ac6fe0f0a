"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of characters.  The distinct blocks of the corpus
are sorted, and a block's name is its place in that order; then adjacent names are paired, the
distinct pairs are sorted and named in the same way, until each document is left with one name.
Equal documents get equal names and different documents different ones: no name is a digest.

Blocks are sorted by (64-bit key, content).  The content decides only where keys tie, so after
the one shuffle that compares contents, names travel as integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import FILE, ROW, integer_names, numbered
from folioseek.session import staged

BLOCK = 2_048


def _named_blocks(texts: DataFrame, rows: DataFrame, cut: Column, key: Callable[[Column], Column]) -> DataFrame:
    """One row per block of each document: file, row, n (blocks), pos, name."""
    contents = texts.select(F.explode(cut).alias("content")).withColumn("key", key(F.col("content")))
    groups = contents.groupBy("key").agg(F.array_sort(F.collect_set("content")).alias("contents"))
    tied = F.size("contents") > 1
    ordered = groups.select("key", tied.alias("tied"), F.posexplode(F.when(tied, F.col("contents")).otherwise(
        F.array(F.lit(None).cast("string")))).alias("place", "content"))
    names = staged(integer_names(ordered, "key", "place"), "block-names")

    blocks = rows.select(FILE, ROW, F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    first = names.filter(~F.col("tied")).select("key", "name")
    plain = blocks.join(first, "key").select(FILE, ROW, "n", "pos", "name")
    ties = names.filter("tied").select("key", "content", "name")
    if ties.isEmpty():
        return staged(plain, "blocks")
    spelled = (
        texts.select(FILE, ROW, F.posexplode(cut).alias("pos", "content"))
        .withColumn("key", key(F.col("content")))
        .join(ties, ["key", "content"])
        .select(FILE, ROW, "pos", "name")
    )
    counts = rows.select(FILE, ROW, F.size("keys").alias("n"))
    return staged(plain.unionByName(spelled.join(counts, [FILE, ROW]).select(FILE, ROW, "n", "pos", "name")), "blocks")


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    key: Callable[[Column], Column] = lambda content: F.xxhash64(content),
) -> DataFrame:
    """One row per row of ``docs``: file and row key, doc_id, keep_id, group_size, kept, text_sha256, blocks, name.

    Of equal texts the row with the largest id stays; of rows that also share the id, one.  A null
    text counts as empty and all empty texts are one group (no blocks, name 0).  A null id loses
    to any other; if a group has no other, keep_id is null and one row of it stays.  An empty
    table gives an empty result.  Further columns of ``docs`` are not read.
    """
    texts = numbered(docs, doc_id=F.col(id_col), text=F.coalesce(F.col(text_col), F.lit("")))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    rows = staged(
        texts.select(FILE, ROW, "doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(cut, key).alias("keys")),
        "texts",
    )
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 0
    level = _named_blocks(texts, rows, cut, key)
    done = []
    while longest > 1:
        done.append(level.filter("n = 1"))
        left, right = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = (
            level.filter("n > 1")
            .groupBy(FILE, ROW, F.floor((F.col("n") + 1) / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(left.alias("left"), F.coalesce(right, F.lit(0)).alias("right"))
        )
        pairs = staged(pairs, "pairs")
        names = staged(integer_names(pairs.select("left", "right").distinct(), "left", "right"), "pair-names")
        level = staged(pairs.join(names, ["left", "right"]).select(FILE, ROW, "n", "pos", "name"), "level")
        longest = (longest + 1) // 2
    done.append(level)

    names = done[0]
    for part in done[1:]:
        names = names.unionByName(part)
    # Documents with equally many blocks end at the same level: count and name are the identity.
    named = staged(
        rows.select(FILE, ROW, "doc_id", "text_sha256", F.size("keys").cast("long").alias("blocks"))
        .join(names.select(FILE, ROW, "name"), [FILE, ROW], "left")
        .withColumn("name", F.coalesce("name", F.lit(0))),
        "identities",
    )
    groups = staged(
        named.groupBy("blocks", "name").agg(
            F.max(F.struct("doc_id", FILE, ROW)).alias("stays"), F.count(F.lit(1)).alias("group_size")
        ),
        "groups",
    )
    return named.join(groups, ["blocks", "name"]).select(
        FILE,
        ROW,
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        ((F.col(f"stays.{FILE}") == F.col(FILE)) & (F.col(f"stays.{ROW}") == F.col(ROW))).alias("kept"),
        "text_sha256",
        "blocks",
        "name",
    )
