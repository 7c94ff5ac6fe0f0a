"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.session import staged




def components(links: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for each node of links ``(u, v)``; the root is the least node reachable.

    Each round joins all larger neighbours of a node to its least one (large star), then its
    smaller neighbours and itself (small star), until nothing changes; rounds grow with the
    logarithm of the longest path.  Every half round is written to the shared folder.  Least
    neighbours are pre-aggregated, and links join them by key, so a node with very many
    links is split over tasks.
    """
    edges = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    mark = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")))
    before = edges.agg(*mark).first()
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = staged(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(),
            "large",
        )
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        after = edges.agg(*mark).first()
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
