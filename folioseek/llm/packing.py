"""Packing documents into padded batches of optimal length buckets.

The corpus' histogram of lengths decides the bucket boundaries: dynamic programming finds those
with the least padding in total.  Inside a bucket every batch holds as many documents as the
token budget allows at the bucket's padded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioseek.llm.common import FILE, ROW, WORD, numbered, uniform
from folioseek.session import staged

EXACT_BITS = 13


def boundaries_by_count(histogram: list[tuple[int, int]], buckets: int) -> list[tuple[int, list[int]]]:
    """For 1, 2, ... ``buckets`` buckets (no more than there are lengths) the least total padding and the upper lengths.

    With prefix counts C and prefix tokens S, closing a bucket of lengths i..j costs
    L[j] * (C[j] - C[i]) - (S[j] - S[i]).  For each j that is the least of lines in L[j] with slope
    -C[i], and both come in order, so a lower hull answers all j in linear time.
    """
    histogram = sorted(histogram)
    lengths = [x for x, _ in histogram]
    buckets = min(buckets, len(lengths))
    count, tokens = [0], [0]
    for x, n in histogram:
        count.append(count[-1] + n)
        tokens.append(tokens[-1] + n * x)
    size = len(lengths)
    best: list[int | None] = [0] + [None] * size
    came: list[list[int]] = []
    least: list[int] = []
    for _ in range(buckets):
        hull: list[tuple[int, int, int]] = []
        at = 0
        now: list[int | None] = [None] * (size + 1)
        back = [0] * (size + 1)
        for j in range(1, size + 1):
            if best[j - 1] is not None:
                m, c = -count[j - 1], best[j - 1] + tokens[j - 1]
                while len(hull) >= 2:
                    (m1, c1, _), (m2, c2, _) = hull[-2], hull[-1]
                    # The middle line is never below both neighbours.
                    if (c - c1) * (m1 - m2) <= (c2 - c1) * (m1 - m):
                        hull.pop()
                    else:
                        break
                hull.append((m, c, j - 1))
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            m, c, back[j] = hull[at]
            now[j] = m * x + c + x * count[j] - tokens[j]
        best = now
        came.append(back)
        least.append(now[size])
    out = []
    for k, padding in enumerate(least, 1):
        ends, j = [], size
        for back in reversed(came[:k]):
            ends.append(lengths[j - 1])
            j = back[j]
        out.append((padding, ends[::-1]))
    return out


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int, budget: int | None = None) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding.

    No bucket holds lengths on both sides of ``budget``; so there are two buckets at least if both occur.
    """
    short = [(x, n) for x, n in histogram if budget is None or x <= budget]
    long = [(x, n) for x, n in histogram if budget is not None and x > budget]
    if not short or not long:
        return boundaries_by_count(short or long, buckets)[-1][1] if histogram else []
    buckets = max(buckets, 2)
    low, high = boundaries_by_count(short, buckets - 1), boundaries_by_count(long, buckets - 1)
    pairs = [(low[a][0] + high[min(buckets - a - 2, len(high) - 1)][0], a) for a in range(len(low))]
    a = min(pairs)[1]
    return low[a][1] + high[min(buckets - a - 2, len(high) - 1)][1]


def rounded_length(name: str) -> Column:
    """The length, exact below 2^13; above, rounded up to 13 leading bits, so the histogram stays small."""
    shift = f"greatest(length(bin({name})) - {EXACT_BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({name} + shiftleft(1L, {shift}) - 1, {shift}), {shift})")


def pack_by_length(
    docs: DataFrame,
    *,
    buckets: int = 16,
    budget: int = 16_384,
    length: Column | None = None,
    cells: int = 256,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, length, bucket, bucket_length, batch, place, padding.

    ``length`` counts words (or is the given expression over ``docs``, at least 0); a null text has
    length 0.  ``batch`` counts from 0 inside its bucket, ``place`` from 0 inside its batch, and a
    batch times the bucket's length stays within ``budget``; only documents longer than the budget
    are batches of their own, whole, and they share no bucket with others.  Every batch but the last of a bucket is full.  Ties and
    repeated rows each have a place of their own; an empty table gives an empty result.

    The driver receives one row per distinct rounded length: at most 2^13 + 2^12 x (64 - 13).
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
    rows = numbered(docs, doc_id=F.col(id_col), n=(words if length is None else F.coalesce(length, F.lit(0))).cast("long"))
    rows = staged(
        rows.select(FILE, ROW, "doc_id", F.col("n").alias("length"))
        .withColumn("rounded", F.when(F.col("length") <= budget, F.least(rounded_length("length"), F.lit(budget))).otherwise(rounded_length("length")))
        .withColumn("u", uniform("doc_id", "length", ROW, seed=seed)),
        "lengths",
    )
    histogram = [(r.rounded, r.n) for r in rows.groupBy("rounded").agg(F.count(F.lit(1)).alias("n")).collect()]
    ends = optimal_boundaries(histogram, buckets, budget) or [0]
    upper = F.array(*(F.lit(x).cast("long") for x in ends))
    placed = rows.withColumn("bucket", F.size(F.filter(upper, lambda end: end < F.col("length")))).withColumn(
        "cell", F.floor(F.col("u") * cells).cast("int")
    )
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("cell")) - F.col("n")
    starts = placed.groupBy("bucket", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("bucket").alias("b"), F.col("cell").alias("c"), before.alias("start")
    )
    inside = Window.partitionBy("bucket", "cell").orderBy("u", FILE, ROW)
    position = F.col("start") + F.row_number().over(inside) - 1
    return (
        # at most buckets x cells rows
        placed.join(F.broadcast(starts), (F.col("bucket") == F.col("b")) & (F.col("cell") == F.col("c")))
        .withColumn("position", position)
        .withColumn("bucket_length", F.element_at(upper, F.col("bucket") + 1))
        .withColumn("fits", F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1)))
        .select(
            "doc_id", "length", "bucket", "bucket_length",
            F.floor(F.col("position") / F.col("fits")).alias("batch"),
            F.pmod("position", "fits").alias("place"),
            (F.col("bucket_length") - F.col("length")).alias("padding"),
        )
    )
