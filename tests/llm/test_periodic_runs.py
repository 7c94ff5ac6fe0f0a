import hashlib
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from folioseek.llm.periodic_runs import collapsed, find_runs, places_of_runs, planted, runs_of, strongest, word_runs


def brute(words, least=24, powers=3):
    """Every period is tried over the whole text; a stretch whose smallest period is shorter is left to that one."""
    names = {}
    x = np.array([names.setdefault(w, len(names)) for w in words], dtype=int)
    found = []
    for q in range(1, len(x) // powers + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        found += [(int(b), int(e - b + q), q) for b, e in zip(edges[::2], edges[1::2]) if e - b + q >= max(least, powers * q)]
    inside = lambda r, o: o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1]
    return sorted((r for r in found if not any(inside(r, o) for o in found)), key=lambda r: (r[0], r[2]))


def some_words(rng, most):
    words = []
    while len(words) < most:
        kind = rng.random()
        if kind < 0.3:
            words += [str(rng.randint(0, rng.choice([1, 3, 100]))) for _ in range(rng.randint(1, 30))]
        elif kind < 0.7:
            unit = [str(rng.randint(0, rng.choice([1, 2, 50]))) for _ in range(rng.randint(1, 14))]
            words += (unit * 8)[: rng.randint(1, 7 * len(unit))]
        elif words:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randint(1, 60)]
    return words


def test_runs_against_every_period():
    rng = random.Random(1)
    for _ in range(600):
        words = some_words(rng, rng.randint(1, 200))
        for least, powers in ((24, 3), (6, 3), (4, 2)):
            want = brute(words, least, powers)
            names = {w: i for i, w in enumerate(dict.fromkeys(words))}
            assert sorted(runs_of([names[w] for w in words], least, powers), key=lambda r: (r[0], r[2])) == want
            assert word_runs(words, least, powers) == want


def test_bounds_of_a_run():
    unit = [f"u{i}" for i in range(9)]
    assert word_runs(["a", "b"] * 12) == [(0, 24, 2)] and word_runs(["a", "b"] * 11 + ["a"]) == []
    assert word_runs(["x"] + unit * 3 + ["y"]) == [(1, 27, 9)] and word_runs((unit * 3)[:-1]) == []
    assert word_runs(["a"] * 30 + ["b"] * 30) == [(0, 30, 1), (30, 30, 1)]
    assert collapsed(["a"] * 30 + ["b"] * 30, [(0, 30, 1), (30, 30, 1)]) == ["a", "b"]
    assert strongest([(5, 48, 2), (0, 24, 1), (3, 24, 1)]) == (0, 24, 1) and strongest([]) is None
    assert strongest([(0, 10**17 + 1, 10**16), (9, 10**17 + 2, 10**16)]) == (9, 10**17 + 2, 10**16)


def test_long_texts_take_linear_time():
    rng = random.Random(2)
    began = time.time()
    assert runs_of([0] * 200_000) == [(0, 200_000, 1)]
    unit = [rng.randrange(10**6) for _ in range(25_000)]
    assert runs_of(unit * 8) == [(0, 200_000, 25_000)]
    assert places_of_runs(np.array([rng.randrange(3_000) for _ in range(500_000)])) == []
    assert time.time() - began < 60


def expected(doc_id, text):
    words = planted(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc_id)
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(some_words(rng, 150))) for i in range(150)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 40), (None, "a " * 40), (7, "é x " * 30), (-5, "w " * 25), (8, "a b\x85c " * 9), (9, "z " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("runs", F.lit(1))
    got = find_runs(docs, plant=True).collect()
    want = [expected(*r) for r in rows]
    assert sorted((tuple(r)[:8] for r in got), key=repr) == sorted(want, key=repr)
    assert any(w[1] > 1 for w in want) and sum(planted(t.split(), i) != t.split() for i, t in rows[:150]) > 3
    for r in got:
        assert [(x.start, x.period) for x in r.runs] == sorted((x.start, x.period) for x in r.runs)
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256
    assert find_runs(docs.limit(0)).collect() == []
    assert {(r.doc_id, r.n_runs) for r in find_runs(docs.filter("doc_id = 9 and text like 'z%'"), keep_texts=False).collect()} == {(9, 1)}
