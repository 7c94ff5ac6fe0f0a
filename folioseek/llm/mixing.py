"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size is the number of copies each of its documents is due.
Whole copies are certain.  What remains of the target is a sample: documents are ranked by their
random odds u/(1-u) over their inclusion odds p/(1-p), and taken in that order until the words of
the source's remainder are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioseek.llm.common import FILE, ROW, WORD, maybe_broadcast, numbered, uniform
from folioseek.session import staged

CELLS = 1_024


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Targets of sources ``(source, source_size)``: weights repeat in code point order, null last.

    The level at which every uncapped source gets level x weight is found in one pass: sources that
    reach their cap first are taken out in turn, which raises the level for the others; the level
    is the highest of those values.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*(F.lit(float(w)) for w in weights))
    rows = sizes.withColumn("weight", F.element_at(listed, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    most = F.col("source_size") * F.lit(float(cap))
    by_need = Window.orderBy("need", F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        rows.withColumn("most", most)
        .withColumn("need", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", "weight", F.least("most", F.col("weight") * F.col("level")).alias("target"))
    )


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    inclusion: Column | None = None,
    cells: int = CELLS,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: file and row key, doc_id, source, size, source_size, target, copies, taken.

    ``size`` counts the words of the text (null or empty: 0), ``taken`` is copies x size.  A source's
    taken words differ from its target by less than one document.  ``inclusion`` is an optional
    positive weight per row that scales a document's inclusion probability (default: all documents of a source
    alike, so probabilities differ between sources).  Draws depend on id, text and seed only; rows
    equal in both tie and are ordered by their place in the input, so reruns give the same rows.
    Null sources are one source.  Documents without words take nothing.  An empty table gives none.

    A source is never sorted as a whole: rank cells are summed, and only the cell in which the
    remainder ends is put in order; a source due whole copies alone has no such cell.
    """
    weight = F.lit(1.0) if inclusion is None else inclusion.cast("double")
    rows = numbered(docs, doc_id=F.col(id_col), text=F.col(text_col), source=F.col(source_col), include=weight)
    rows = staged(
        rows.select(
            FILE, ROW, "doc_id", "source", "include",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            uniform("doc_id", F.xxhash64("text"), seed=seed).alias("u"),
        ),
        "sizes",
    )
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("include").alias("mean"))
    targets = source_targets(totals.drop("mean"), weights, share, cap).join(
        totals.select(F.col("source").alias("s"), "mean"), F.col("source").eqNullSafe(F.col("s"))
    )
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(due)
    targets = staged(
        targets.select(
            key.alias("key"), "source_size", "target", "mean", whole.alias("whole"),
            (F.col("target") - whole * F.col("source_size")).alias("rest"), (due - whole).alias("p"),
        ),
        "targets",
    )
    sources = targets.count()

    p = F.least(F.col("p") * F.col("include") / F.col("mean"), F.lit(1 - 1e-9))
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - p) / p)
    ranked = (
        rows.withColumn("key", key)
        .join(maybe_broadcast(targets, sources), "key")
        .withColumn("rank", F.when((F.col("p") > 0) & (p > 0), odds / (1 + odds)).otherwise(1.0))
        .withColumn("cell", F.least(F.floor(F.col("rank") * cells), F.lit(cells - 1)).cast("int"))
    )
    summed = ranked.groupBy("key", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    running = F.sum("words").over(Window.partitionBy("key").orderBy("cell"))
    spans = staged(
        summed.withColumn("after", running)
        .withColumn("before", F.col("after") - F.col("words"))
        .select("key", "cell", "before", (F.col("after") <= F.col("rest")).alias("within"), ((F.col("before") > F.col("rest")) | (F.col("rest") <= 0)).alias("beyond")),
        "cells",
    )
    placed = ranked.join(maybe_broadcast(spans, sources * cells), ["key", "cell"])
    kept = (FILE, ROW, "doc_id", "source", "size", "source_size", "target", "whole")
    decided = placed.filter("within OR beyond").select(*kept, F.when(F.col("within"), 1).otherwise(0).alias("extra"))
    in_order = Window.partitionBy("key", "cell").orderBy("rank", "doc_id", "size", FILE, ROW)
    ahead = F.col("before") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    cut = (
        placed.filter("NOT (within OR beyond)")
        .withColumn("ahead", ahead)
        .select(*kept, F.when((F.col("p") > 0) & (2 * F.col("ahead") + F.col("size") <= 2 * F.col("rest")), 1).otherwise(0).alias("extra"))
    )
    return decided.unionByName(cut).withColumn("copies", (F.col("whole") + F.col("extra")).cast("long")).select(
        FILE, ROW, "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
