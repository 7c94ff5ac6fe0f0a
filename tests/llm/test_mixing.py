import re
from collections import defaultdict

from pyspark.sql import functions as F

from folioseek.llm.mixing import mix_sources


def wanted_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    target, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        weight = sum(w[s] for s in free)
        target = {s: cap * sizes[s] if s in capped else rest * w[s] / weight for s in names}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def rows_of(spark, data, **more):
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    return mix_sources(docs, **more).collect()


def test_targets_and_totals(spark):
    data = []
    for s, n in (("a", 400), ("b", 90), ("ä", 30), ("B", 5), (None, 40), ("one", 1), ("none", 3)):
        data += [(len(data) + i, " ".join(["w"] * (1 + (i * 7) % 40)) if s != "none" else [None, "", " \t"][i], s) for i in range(n)]
    data += [(3, "copy of a row", "a")] * 50 + [(None, "null id", "b")]
    got = rows_of(spark, data, cells=8)
    assert len(got) == len(data)
    sizes = defaultdict(int)
    longest = defaultdict(int)
    for _, t, s in data:
        sizes[s] += words(t)
        longest[s] = max(longest[s], words(t))
    target, taken = wanted_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s]
    again = rows_of(spark, list(reversed(data)), cells=8)
    plain = lambda rows: sorted((r.doc_id or -1, r.source or "", r.size, r.taken) for r in rows)
    assert plain(got) == plain(again)


def test_inclusion_weights_favour_rows(spark):
    data = [(i, "one two", "ab"[i % 2]) for i in range(2000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mix_sources(docs, share=0.5, weights=(1,), inclusion=F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0), cells=16).collect()
    high = sum(r.copies for r in got if r.doc_id % 4 < 2)
    assert sum(r.copies for r in got) == 1000 and high > 650


def test_pareto_order_against_the_draws(spark):
    """Ranks are odds of a draw over odds of inclusion; the remainder is taken in that order."""
    from folioseek.llm.common import uniform

    data = [(i, "w " * (1 + i % 13), "ab"[i % 3 == 0]) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    weight = lambda n: (n + 1) ** 0.5
    got = {r.doc_id: r for r in mix_sources(docs, inclusion=F.sqrt(F.length("text") + 1), cells=8).collect()}
    draws = {r.doc_id: r.u for r in docs.select("doc_id", uniform("doc_id", F.xxhash64("text"), seed=7).alias("u")).collect()}
    for source in "ab":
        rows = [(i, len(t)) for i, t, s in data if s == source]
        mean = sum(weight(n) for _, n in rows) / len(rows)
        due = got[rows[0][0]].target / got[rows[0][0]].source_size
        rest, ranks = (due - int(due)) * got[rows[0][0]].source_size, []
        for i, n in rows:
            p, u = min((due - int(due)) * weight(n) / mean, 1 - 1e-9), draws[i]
            ranks.append(((u / (1 - u)) * ((1 - p) / p), i) if p > 0 else (2.0, i))
        ahead = 0
        for _, i in sorted(ranks):
            assert got[i].copies == int(due) + (rest > 0 and 2 * ahead + got[i].size <= 2 * rest)
            ahead += got[i].size


def test_empty_and_wordless(spark):
    assert rows_of(spark, [(1, None, "a"), (2, " ", None)])[0].taken == 0
    assert rows_of(spark, []) == []
