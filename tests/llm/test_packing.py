import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from folioseek.llm.packing import optimal_boundaries, pack_by_length


def padding(histogram, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram)


def test_boundaries_against_all_choices():
    rng = random.Random(4)
    for _ in range(150):
        lengths = rng.sample(range(60), rng.randint(1, 9))
        histogram = [(x, rng.randint(1, 50)) for x in lengths]
        for k in (1, 2, 3, 4):
            ends = optimal_boundaries(histogram, k)
            top = max(lengths)
            least = min(padding(histogram, (*c, top)) for m in range(k) for c in combinations([x for x in lengths if x != top], m))
            assert len(ends) <= k and ends == sorted(ends) and padding(histogram, ends) == least


def test_boundaries_that_part_at_the_budget():
    rng = random.Random(5)
    for _ in range(200):
        lengths = rng.sample(range(60), rng.randint(1, 9))
        histogram, budget = [(x, rng.randint(1, 50)) for x in lengths], rng.randint(0, 60)
        short, long = [x for x in lengths if x <= budget], [x for x in lengths if x > budget]
        for k in (2, 3, 4):
            ends = optimal_boundaries(histogram, k, budget)
            forced = {max(x) for x in (short, long) if x}
            least = min(padding(histogram, (*c, *forced)) for m in range(k - len(forced) + 1) for c in combinations(sorted(set(lengths) - forced), m))
            assert len(ends) <= k and forced <= set(ends) and ends == sorted(set(ends)) and padding(histogram, ends) == least


def test_no_batch_is_over_the_budget(spark):
    lengths = [500] * 40 + [6_646, 16_383, 16_384, 16_385, 20_020, 30_000] + list(range(1, 9_000, 37))
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long").withColumn("text", F.lit(""))
    for buckets, budget in ((1, 16_384), (3, 16_384), (16, 16_384), (4, 10_001)):
        rows = pack_by_length(docs, length=F.col("n"), buckets=buckets, budget=budget).collect()
        batches = defaultdict(list)
        for r in rows:
            batches[r.bucket, r.batch].append(r)
        assert len(rows) == len(lengths)
        for held in batches.values():
            own = held[0].length > budget
            assert len(held) == 1 if own else len(held) * held[0].bucket_length <= budget


def test_batches(spark):
    rng = random.Random(2)
    data = [(i, " ".join(["w"] * rng.randint(0, 80))) for i in range(700)] + [(None, None), (1, ""), (2, "w " * 30_001)] + [(9, "a b")] * 60
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("batch", F.lit("x")).withColumn("length", F.lit("y"))
    got = pack_by_length(docs, buckets=4, budget=512, cells=4).collect()
    assert sorted(r.length for r in got) == sorted(len((t or "").split()) for _, t in data)
    batches = defaultdict(list)
    for r in got:
        assert r.length <= r.bucket_length and r.padding == r.bucket_length - r.length
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), rows in batches.items():
        fits = max(1, 512 // max(1, rows[0].bucket_length))
        last = max(b for k, b in batches if k == bucket)
        assert len(rows) == fits if batch < last else 0 < len(rows) <= fits
        assert sorted(r.place for r in rows) == list(range(len(rows)))
    assert pack_by_length(docs.limit(0)).count() == 0


def test_long_lengths_are_rounded_up(spark):
    docs = spark.createDataFrame([(n,) for n in (0, 1, 8191, 8192, 8193, 100_001, 2**40 + 1)], "doc_id long").withColumn("text", F.lit(""))
    got = {r.doc_id: r.bucket_length for r in pack_by_length(docs, length=F.col("doc_id"), buckets=50).collect()}
    assert got[8191] == 8191 and got[8193] == 8194 and got[100_001] == 100_016 and got[2**40 + 1] == 2**40 + 2**28 and got[0] == 0
