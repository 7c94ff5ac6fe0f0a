import random
import time

import pytest
from pyspark.sql import functions as F

from folioseek.operators.proximity import _least_spread


def plain(chain):
    """Every pair of neighbouring lists' places."""
    costs = {p: 0 for p in chain[0]}
    for positions in chain[1:]:
        costs = {p: min(c + abs(p - q - 1) for q, c in costs.items()) for p in positions}
    return min(costs.values())


def spread(spark, chains):
    rows = spark.createDataFrame(list(enumerate(chains)), "id int, chain array<array<int>>")
    return [r.s for r in rows.select("id", _least_spread(F.col("chain")).alias("s")).orderBy("id").collect()]


@pytest.mark.parametrize("seed,most,reach", [(1, 1, 6), (2, 4, 30), (3, 40, 60), (4, 12, 5000)])
def test_against_all_pairs(spark, seed, most, reach):
    rng = random.Random(seed)
    chains = [
        [sorted(rng.sample(range(reach), min(reach, rng.randint(1, most)))) for _ in range(rng.randint(2, 6))]
        for _ in range(120)
    ]
    assert spread(spark, chains) == [plain(c) for c in chains]


def test_unsorted_and_repeated_places(spark):
    chains = [[[9, 3, 3], [4, 40, 4]], [[5, 1], [1, 5], [5, 1]], [[7], [7]], [[0, 2], [2, 0]]]
    assert spread(spark, chains) == [plain(c) for c in chains]


def test_many_places_of_two_words(spark):
    """10,000 places each, the nearest pair hidden among them: all pairs would be 100 million."""
    one = [i * 100 for i in range(10_000)]
    two = [i * 100 + 50 for i in range(10_000)]
    two[7_777] = one[7_777] + 4
    start = time.monotonic()
    assert spread(spark, [[one, two], [two, one], [one, two, one]]) == [3, 5, 8]
    assert time.monotonic() - start < 20
