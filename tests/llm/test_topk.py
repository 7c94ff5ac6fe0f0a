import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioseek.llm.topk import TopK, quantised, search_block, segments, top_inner_products


def brute(vectors, queries, k):
    out = []
    for qi, q in queries:
        if qi is None or q is None or None in q:
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i is not None and i != qi and v is not None and None not in v
        ]
        out += [(qi, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def made(n, seed=3, spread=8, width=12):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, spread)) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("spread", [8, 1, 3_000_000])
def test_against_all_products(spark, spread):
    vectors = made(400, spread=spread)
    vectors += [(1000 + i, list(vectors[5][1])) for i in range(40)] + [(7, list(vectors[7][1])), (2000, None), (2001, [1, None]), (2002, []), (2003, [5] * 20), (None, [1] * 12), (2004, [0] * 12)]
    rows = spark.createDataFrame(vectors, "id long, v array<long>").withColumn("score", F.lit("x"))
    asked = rows.filter("id % 20 = 0 OR id = 7 OR id > 1990 OR id IS NULL")
    queries = [(i, v) for i, v in vectors if i is None or i % 20 == 0 or i == 7 or i > 1990]
    got = top_inner_products(rows, asked, k=5, group=100, block=32, query_block=16).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(vectors, queries, 5)


def test_stops_before_the_last_segment_on_proof():
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.normal(0, 0.125, (4096, 64))).astype(np.int64)
    x[7] = x[3]
    ids, best = np.arange(4096), TopK(50, 10)
    done = [search_block(x[:50], ids[:50], segments(ids[a : a + 1024], x[a : a + 1024]), best) for a in range(0, 4096, 1024)]
    levels = len(segments(ids[:1024], x[:1024])) - 1
    assert done[0] == levels and max(done[1:]) < levels
    scores = x[:50] @ x.T
    for i in range(50):
        want = sorted((-scores[i, j], j) for j in range(4096) if j != i)[:10]
        assert [(-s, j) for s, j in zip(best.score[best.q == i], best.id[best.q == i])] == want


def test_few_or_no_rows(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "id long, v array<long>")
    assert top_inner_products(rows, rows).count() == 2
    assert top_inner_products(rows, rows.limit(0)).count() == 0 and top_inner_products(rows.limit(0), rows).count() == 0


def test_quantised(spark):
    rows = spark.createDataFrame([([0.5, -0.01],), ([1.0, float("nan")],), ([float("-inf")],), ([None],), ([],), (None,)], "e array<float>")
    assert [r.v for r in rows.select(quantised(F.col("e")).alias("v")).collect()] == [[32, -1], None, None, None, [], None]
