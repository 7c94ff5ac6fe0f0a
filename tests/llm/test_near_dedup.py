import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from folioseek.llm.components import components
from folioseek.llm.near_dedup import near_duplicates
from folioseek.llm.shingles import shingle_set


def brute(rows, size):
    sets = [shingle_set((t or "").encode(), size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(s), least.get(find(i), -1)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for length in (1, 2, 3, 9, 40, 120, 300, 800):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(length)]
            for edits in (0, 0, 1, 2, 4, 8, 12):
                words = list(base)
                for _ in range(min(edits, length)):
                    words[rng.randrange(length)] = rng.choice(vocabulary)
                rows.append((n, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
                n += 1
    # Many near copies of one text, some too far from all others, some alike only among themselves.
    base = [rng.choice(vocabulary) for _ in range(90)]
    for k in range(70):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 7, 9, 11])):
            words[rng.randrange(90)] = rng.choice(vocabulary[:60])
        for _ in range(1 + (k % 9 == 0)):
            rows.append((n, " ".join(words)))
            words[rng.randrange(90)] = f"own{k}"
            n += 1
    # A chain: neighbours are alike, the ends are not.
    words = [f"c{i}" for i in range(200)]
    for k in range(12):
        words[k * 6 : k * 6 + 6] = [f"x{k}_{i}" for i in range(6)]
        rows.append((n, " ".join(words)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "É é"), (n + 4, "é É"), (n + 5, "a b c"), (None, rows[0][1]), (None, "only null ids")]
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_against_all_pairs(spark, size):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("kept", F.lit("x"))
    got = near_duplicates(docs, size=size).collect()
    plain = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got)
    assert plain == brute(rows, size)
    for r in got:
        if r.doc_id is not None:
            assert r.kept == (r.doc_id == r.component_id)


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(4, "a b c d e f")] * 30 + [(5, "z")], "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert sum(r.kept for r in got) == 2 and len(got) == 31
    assert near_duplicates(docs.limit(0)).count() == 0


def test_many_near_copies_with_a_stray_component(spark):
    """Behind one first class: thousands in one component, and texts whose words they only partly share."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(3000):
        words = list(base)
        words[rng.randrange(60)] = f"own{k}"
        rows.append((k, " ".join(words)))
    for k in range(3000, 3040):  # five words apart: mostly no link to any
        words = list(base)
        for at in rng.sample(range(60), 5):
            words[at] = f"far{k}_{at}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, size=2).collect()}
    sets = {d: shingle_set(t.encode(), 2) for d, t in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert all(got[k] == 0 for k in range(3000))
    strays = range(3000, 3040)
    for k in strays:
        if any(near(k, j) for j in range(3000)):
            assert got[k] == 0
    for a, b in combinations(strays, 2):
        assert not near(a, b) or got[a] == got[b]
    assert len({got[k] for k in strays}) > 1


def test_components(spark):
    links = [(i, i + 1) for i in range(60) if i % 17] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 150), (150, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[k] == 100 for k in range(100, 140)) and got[200] == 150 and got[16] == 1 and got[33] == 18 and got[60] == 52
    assert 0 not in got and 61 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
