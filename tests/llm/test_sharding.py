from collections import Counter, defaultdict
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioseek.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards


def test_hypergeometric_follows_its_law():
    from math import comb

    rng = np.random.default_rng(1)
    draws = Counter(hypergeometric(rng, 7, 13, 8) for _ in range(20_000))
    for k in range(8):
        want = comb(7, k) * comb(13, 8 - k) / comb(20, 8)
        assert abs(draws[k] / 20_000 - want) < 0.015
    big = hypergeometric(rng, 10**10, 2 * 10**10, 10**9)
    assert abs(big - 10**9 / 3) < 10 * (10**9 * 2 / 9) ** 0.5
    assert hypergeometric(rng, 5, 0, 3) == 3 and hypergeometric(rng, 0, 5, 3) == 0


def test_matrix_totals():
    counts = [0, 5, 17, 1, 100]
    m = communication_matrix(counts, 7, 3)
    assert [sum(r) for r in m] == counts
    columns = [sum(r[j] for r in m) for j in range(7)]
    assert max(columns) - min(columns) <= 1 and sum(columns) == 123


def check(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by.get(j, [])) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_rows_with_nulls_copies_and_clashing_columns(spark):
    data = [(i, f"t{i}é") for i in range(300)] + [(None, None), (None, ""), (7, "x" * 9000)] + [(5, "same")] * 200
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("slot", F.lit("x")).withColumn("size", F.lit(1))
    got = shuffle_into_shards(docs, parts=16, cells=4).collect()
    check(got, 24)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    # copies spread like any other rows
    assert len({r.shard for r in got if r.doc_id == 5}) > 15


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    check(shuffle_into_shards(few, parts=4).collect(), 24)
    assert shuffle_into_shards(few.limit(0), parts=4).count() == 0


def test_every_shard_is_equally_likely(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shuffle_into_shards(docs, shards=4, parts=8, cells=4).collect()
    low = Counter(r.shard for r in rows if r.doc_id < 1000)
    assert all(abs(low[j] - 250) < 70 for j in range(4))
    first_half = sum(r.slot < 500 for r in rows if r.doc_id < 1000)
    assert abs(first_half - 500) < 90
