"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows lie in logical partitions.  How many rows each partition sends to each shard is drawn
first, from the distribution a uniform permutation of all rows would give (multivariate
hypergeometric, so partition and shard totals are exact).  Then each partition permutes its
rows and deals them out by these counts, and each shard permutes what it received.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioseek.llm.common import FILE, ROW, numbered, text_bytes_crc
from folioseek.session import staged

PARTS, CELLS = 1_024, 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls are good; any counts, by inversion around the mean."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mean = drawn * (good / total)
    sd = np.sqrt(mean * (bad / total) * ((total - drawn) / max(1, total - 1)))
    a, b = max(low, int(mean - 12 * sd) - 10), min(high, int(mean + 12 * sd) + 10)
    k = np.arange(a, b, dtype=float)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each partition for each shard; shard totals are at most one apart, the larger ones first."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for n in counts:
        line, left, others = [], n, sum(room)
        for j in range(shards):
            others -= room[j]
            line.append(hypergeometric(rng, room[j], others, left))
            left -= line[-1]
        room = [r - x for r, x in zip(room, line)]
        matrix.append(line)
    return matrix


def shuffle_into_shards(
    docs: DataFrame,
    *,
    shards: int = 24,
    parts: int = PARTS,
    cells: int = CELLS,
    seed: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot (0, 1, ... inside the shard).

    Size is the UTF-8 bytes of the text plus 8; a null text has none and the checksum of the empty
    text.  Repeated rows and null ids are rows like any other, told apart by their place in the
    file, which also keeps a much repeated row from filling one partition.  Shard sizes differ by
    one at most, so fewer rows than shards leave shards empty; an empty table gives no rows.

    Only ids and checksums are shuffled.  The driver sees one count per logical partition.
    """
    rows = numbered(docs, doc_id=F.col(id_col), text=F.col(text_col))
    crc = text_bytes_crc(F.col("text"))
    draw = lambda k: F.xxhash64(F.lit(seed * 8 + k), "doc_id", crc, ROW)
    rows = staged(
        rows.select(
            FILE, ROW, "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
            crc.alias("text_crc32"),
            F.pmod(draw(0), F.lit(parts)).cast("int").alias("part"), draw(1).alias("local"), draw(2).alias("final"),
        ),
        "rows",
    )
    counted = {r.part: r.n for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = communication_matrix([counted.get(p, 0) for p in range(parts)], shards, seed)
    ends = F.from_json(F.lit(json.dumps(np.cumsum(matrix, axis=1).tolist())), "array<array<bigint>>")

    local = Window.partitionBy("part").orderBy("local", FILE, ROW)
    exchanged = staged(
        rows.withColumn("place", F.row_number().over(local))
        .withColumn("shard", F.size(F.filter(F.element_at(ends, F.col("part") + 1), lambda end: end < F.col("place"))))
        .withColumn("cell", F.pmod(F.shiftright("final", 32), F.lit(cells)))
        .select(FILE, ROW, "doc_id", "size", "text_crc32", "shard", "cell", "final"),
        "exchanged",
    )
    # A shard's order is its cells in turn, each in the order of a hash: no task holds a shard.
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")
    starts = (
        exchanged.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("shard").alias("s"), F.col("cell").alias("c"), before.alias("start"))
    )
    inside = Window.partitionBy("shard", "cell").orderBy("final", FILE, ROW)
    return (
        exchanged.withColumn("place", F.row_number().over(inside) - 1)
        # at most shards x cells rows
        .join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).alias("slot"))
    )
