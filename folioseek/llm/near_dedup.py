"""Near-duplicate groups by circulant MinHash, banding and exact verification.

1. One pass over the texts leaves, per row, the size and a digest of its shingle set and its band
   keys.  Rows with the same set become one class; all further work is on classes.
2. Classes that share a band key are candidates.  Each is compared with the first and the last
   class of each of its bands, which is linear in the size of a band and joins most of a group.
3. Where a band still holds several components, its other pairs across components matter too.
   Let M be any set, and x, y two classes that follow one first class.  What x and y have in common
   lies in M, and is at most what the lesser of them shares with M, or outside M.  So x and y are alike
   only if both share enough with M, which is a test of two numbers, or have a shingle outside M in
   common, which is a join on such shingles; and of these only a prefix in hash order is needed (a
   set of n has at least percent of n in common with what it is like).  M is the first class's set, or
   for many followers what a third of some of them share: then only their differences are left
   outside, and a group of many near copies is not compared pair by pair.  Nothing alike is passed over.
   Pairs inside a component need no test: the answer is the component.
4. Every link between classes is confirmed on the full sets of shingles, as words, never on hashes.  Rows
   become one class where size and two 63-bit digests of the set agree.

Banding finds a pair of similarity s with probability 1 - (1 - s^rows)^bands: at 0.8 with the
defaults it misses 5 in a million, above that far fewer.  There is no cap on bands, candidates or partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import FILE, ROW, numbered, small_batches
from folioseek.llm.components import components
from folioseek.llm.shingles import Circulant, Shingler, shingle_set
from folioseek.session import staged

BANDS, ROWS, PERCENT = 52, 7, 80
#: From so many followers on, the base is what a third of about SOME of them share.
MANY, SOME = 16, 25


def _prints(size: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, circulant = Shingler(size), Circulant(bands, rows, seed)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(3).to_pylist():
                h = shingler.hashes(text)
                line = (0, None, None, None)
                if len(h):
                    total, folded = int(h.sum() >> 1), int((h * h + (h >> 7)).sum() >> 1)
                    line = (len(h), total, folded, circulant.band_keys(circulant.signature(h)))
                for column, value in zip(out, line):
                    column.append(value)
            arrays = [*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.list_(pa.int64()))]
            names = [FILE, ROW, "doc_id", "n", "h1", "h2", "bands"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *arrays], names=names)

    return run


def _compared(size: int, percent: int):
    """Rows (u, v, a, b) of ids and texts to the linked (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, set()
        for batch in batches:
            linked = []
            a, b = batch.column(2), batch.column(3)
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node != last:
                    last, first = node, shingle_set(a[i].as_py(), size)
                second = shingle_set(b[i].as_py(), size)
                common = len(first & second)
                linked.append(100 * common >= percent * (len(first) + len(second) - common))
            both = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"])
            yield both.filter(pa.array(linked, pa.bool_()))

    return run


def _hashed(size: int):
    """Rows (low, text) to (low, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            found = [shingler.hashes(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["low", "hashes"])

    return run


def _outside(size: int, percent: int):
    """Rows (low, node, n, base, text of low, text of node) to (low, node, common, rest).

    ``common`` counts what the node shares with the base, or without one with low; ``rest`` is the
    prefix of its other hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, inside = Shingler(size), None, None
        for batch in batches:
            counts, prefixes = [], []
            base, a, b = batch.column(3), batch.column(4), batch.column(5)
            for i, (low, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if low != last:
                    last, given = low, base[i].as_py()
                    inside = shingler.hashes(a[i].as_py()) if given is None else np.array(given, np.int64).view(np.uint64)
                rest = np.setdiff1d(shingler.hashes(b[i].as_py()), inside, assume_unique=True)
                counts.append(n - len(rest))
                least = max(1, -(-percent * n // 100) - counts[-1])
                prefixes.append(rest[: max(0, len(rest) - least + 1)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["low", "node", "common", "rest"],
            )

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    size: int = 5,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: file and row key, doc_id, n_shingles, component_id, kept.

    Rows are linked when their sets of ``size``-word shingles have at least ``percent`` of their union
    in common; a component is what links reach.  ``component_id`` is its smallest id and the row
    that has it is kept (of repeated rows, one).  A text with fewer words is one shingle; a null,
    empty or blank text has none, is linked with nothing and kept.  Null ids count as largest; a
    component of them only has a null id and one row kept.  Rows that share an id but not
    their text are separate.  An empty table gives an empty result.
    """
    texts = numbered(docs, doc_id=F.col(id_col), text=F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    id_type = dict(texts.dtypes)["doc_id"]
    schema = f"{FILE} long, {ROW} long, doc_id {id_type}, n long, h1 long, h2 long, bands array<long>"
    spark = docs.sparkSession
    with small_batches(spark):
        prints = staged(texts.mapInArrow(_prints(size, bands, rows, seed), schema), "prints")
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", FILE, ROW)
    classes = (
        prints.filter("n > 0").groupBy("n", "h1", "h2")
        .agg(F.min(own).alias("first"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = staged(classes, "classes")  # which fixes the node numbers

    banded = classes.select("node", F.explode("bands").alias("band"))
    ends = staged(
        banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high"), "band-ends"
    )
    shared = staged(banded.join(ends, "band"), "shared-bands")
    pairs = staged(
        shared.select("node", F.explode(F.array("low", "high")).alias("end")).filter("node <> end")
        .select(F.least("node", "end").alias("u"), F.greatest("node", "end").alias("v")).distinct(),
        "pairs",
    )
    spelled = shared.select("node").distinct().join(classes.select("node", f"first.{FILE}", f"first.{ROW}"), "node")
    spelled = staged(texts.join(spelled, [FILE, ROW]).select("node", "text"), "candidate-texts")

    def with_texts(pairs: DataFrame, first: str, second: str) -> DataFrame:
        one = pairs.join(spelled.select(F.col("node").alias(second), F.col("text").alias("b")), second)
        return one.join(spelled.select(F.col("node").alias(first), F.col("text").alias("a")), first)

    def compared(pairs: DataFrame) -> DataFrame:
        both = with_texts(pairs, "u", "v").select("u", "v", "a", "b")
        return both.mapInArrow(_compared(size, percent), "u long, v long")

    with small_batches(spark):
        links = staged(compared(pairs), "links")
    found = staged(components(links), "components")

    # First classes whose followers are in more than one component.
    rooted = shared.select("low", "node").filter("low <> node").distinct().join(found, "node", "left")
    rooted = staged(rooted.withColumn("root", F.coalesce("root", "node")), "followers")
    several = staged(rooted.groupBy("low").agg(F.min("root").alias("p"), F.max("root").alias("q")).filter("p < q").select("low"), "several")
    members = staged(rooted.join(several, "low").join(classes.select("node", "n"), "node").select("low", "node", "root", "n"), "members")
    lows = staged(members.groupBy("node").agg(F.collect_set("low").alias("lows")), "lows")  # at most one per band

    # What many followers share, from about SOME of them: which ones decides no link.
    many = staged(members.groupBy("low").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= MANY), "many")
    some = members.join(many, "low").filter(F.pmod(F.xxhash64("low", "node"), F.ceil(F.col("k") / SOME)) == 0).select("low", "node")
    some = staged(some.join(spelled, "node").select("low", "text").mapInArrow(_hashed(size), "low long, hashes array<long>"), "some")
    often = some.select("low", F.explode("hashes").alias("h")).groupBy("low", "h").agg(F.count(F.lit(1)).alias("c"))
    often = often.join(some.groupBy("low").agg(F.count(F.lit(1)).alias("of")), "low").filter("3 * c >= of")
    bases = staged(often.groupBy("low").agg(F.collect_list("h").alias("base")), "bases")

    # One row per first class, so that its followers meet it in a join that can be split.
    firsts = several.join(spelled.select(F.col("node").alias("low"), F.col("text").alias("a")), "low").join(bases, "low", "left")
    firsts = staged(firsts.select("low", "base", F.when(F.col("base").isNull(), F.col("a")).alias("a")), "firsts")
    outside = members.join(spelled.select("node", F.col("text").alias("b")), "node").join(firsts, "low").select("low", "node", "n", "base", "a", "b")
    with small_batches(spark):
        outside = staged(outside.mapInArrow(_outside(size, percent), "low long, node long, common long, rest array<long>"), "outside")
    placed = staged(members.join(lows, "node").join(outside, ["low", "node"]), "placed")
    members = placed.drop("rest")
    outside = placed.select("low", "node", "root", "n", "lows", F.explode("rest").alias("h"))

    def sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
        return tuple(rows.select([F.col(c).alias(side + c) for c in rows.columns]) for side, rows in (("l_", left), ("r_", right)))

    # Each pair is looked at under the least first class that both follow.
    apart = (
        (F.col("l_low") == F.col("r_low")) & (F.col("l_root") != F.col("r_root"))
        & (100 * F.least("l_n", "r_n") >= percent * F.greatest("l_n", "r_n"))
    )
    once = F.array_min(F.array_intersect("l_lows", "r_lows")) == F.col("l_low")
    # Two that pass the test of pairs each pass this one alone.  Of two components one is not the largest
    # behind the first class, so the others meet all and the largest never meets itself.
    close = members.filter(100 * F.col("common") >= percent * F.col("n"))
    most = close.groupBy("low", "root").agg(F.count(F.lit(1)).alias("of"))
    most = most.groupBy("low").agg(F.max(F.struct("of", "root"))["root"].alias("largest"))
    close = staged(close.join(most, "low").withColumn("stray", F.col("root") != F.col("largest")).drop("largest"), "close")
    left, right = sides(close.filter("stray").drop("stray"), close)
    near_first = left.join(
        right,
        apart & (~F.col("r_stray") | (F.col("l_node") < F.col("r_node")))
        & ((100 + percent) * F.least("l_common", "r_common") >= percent * (F.col("l_n") + F.col("r_n"))) & once,
    )
    left, right = sides(outside, outside)
    across = left.join(right, (F.col("l_h") == F.col("r_h")) & apart & (F.col("l_node") < F.col("r_node")) & once)
    rest = [p.select(F.least("l_node", "r_node").alias("u"), F.greatest("l_node", "r_node").alias("v")).distinct() for p in (near_first, across)]
    rest = staged(rest[0].unionByName(rest[1]).distinct().join(pairs, ["u", "v"], "left_anti"), "rest")
    with small_batches(spark):
        more = staged(compared(rest), "more-links")
    if not more.isEmpty():
        found = staged(components(links.unionByName(more)), "components")

    rooted = classes.select("n", "h1", "h2", "first", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = staged(rooted.drop("node"), "class-roots")
    least = staged(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")
    answers = staged(rooted.join(least, "root").select("n", "h1", "h2", "least"), "answers")
    mine = (F.col(f"least.{FILE}") == F.col(FILE)) & (F.col(f"least.{ROW}") == F.col(ROW))
    linked = prints.filter("n > 0").select(FILE, ROW, "doc_id", "n", "h1", "h2").join(answers, ["n", "h1", "h2"]).select(
        FILE, ROW, "doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), mine.alias("kept")
    )
    alone = prints.filter("n = 0").select(
        FILE, ROW, "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return linked.unionByName(alone)
