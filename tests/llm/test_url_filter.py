from itertools import combinations

import duckdb
from pyspark.sql import functions as F

from folioseek.llm.oracles import ORACLES
from folioseek.llm.url_filter import filter_urls, mine_rules

URLS = [
    ("http://EXAMPLE.org/en/12?x=1", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.example.org/es/", "a.example.org", "/es/", "example.org/es/", "block"),
    ("https://notexample.org/es/1#f", "notexample.org", "/es/1", "org/", "allow"),
    ("x://shop.com/fr/#?", "shop.com", "/fr/", "com/fr/", "allow"),
    ("x://shop.com/de/a?b#c", "shop.com", "/de/a", "com/de/", "block"),
    ("x://com/de/", "com", "/de/", "com/de/", "block"),
    ("x://example.org?q", "example.org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("://É.ORG/", "É.org", "/", "org/", "allow"),
    ("http://h.net/line\nbreak?", "h.net", "/line\nbreak", None, "allow"),
]


def test_listed_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)] + [(None, "http://x.org/"), (0, URLS[0][0])], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_urls(pages.withColumn("host", F.lit("clash")), labels).collect()
    assert len(got) == len(URLS) + 2
    by = {r.page_id: r for r in got}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == (host, path, rule, verdict)
    assert filter_urls(pages.limit(0), labels).count() == 0


def rules_by_counting(rows, min_confidence):
    """All sets of tokens are counted; those a part of which is a rule are left out."""
    known = [(set(t), b) for t, b in rows if b is not None and t is not None]
    where = {}
    for i, (t, _) in enumerate(known):
        for x in t:
            where.setdefault(x, set()).add(i)
    item = {x: min(y for y in where if where[y] == w) for x, w in where.items()}
    known = [({item[x] for x in t}, b) for t, b in known]
    found = {}
    for size in range(1, 9):
        for c in {c for t, _ in known for c in combinations(sorted(t), size)}:
            has = [b for t, b in known if set(c) <= t]
            if sum(has) >= 5 and sum(has) / len(has) >= min_confidence and not any(set(o) < set(c) for o in found):
                found[c] = (len(has), sum(has))
    return found


def mined(spark, rows, **options):
    rules, items = mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), **options)
    return {tuple(sorted(r["items"])): (r.n, r.blocked, r.lead) for r in rules.collect()}, {r.token: r["item"] for r in items.collect()}


def test_rules_against_counting(spark):
    import random

    rng = random.Random(6)
    rows = [(sorted(rng.sample("abcdefg", rng.randint(0, 5))), rng.choice([True, False, None])) for _ in range(300)]
    rows += [(["x", "y", "z"], True)] * 20 + [(["x"], False)] * 20 + [(None, True)]
    got, items = mined(spark, rows, min_confidence=0.55)
    assert {k: v[:2] for k, v in got.items()} == rules_by_counting(rows, 0.55)
    assert got["y",][2] == "y" and items["z"] == items["y"] == "y" and ("x", "y") not in got


def test_shared_paths_are_not_multiplied(spark):
    import time

    path = [f"p{i:02}" for i in range(25)]
    rows = [(path + [f"q{i % 7}"], i % 2 == 0) for i in range(40)] + [([f"q{i % 7}", "r"], i % 3 == 0) for i in range(200)]
    began = time.time()
    got, items = mined(spark, rows)
    assert time.time() - began < 60 and {items[p] for p in path} == {"p00"}
    assert {k: v[:2] for k, v in got.items()} == rules_by_counting(rows, 0.6)


def test_mined_rules_block(spark):
    pages = [(i, f"http://{'spam' if i % 2 else 'good'}.net/p/{i}") for i in range(40)]
    labels = [(i, i % 2 ^ 1, None) for i in range(20)] + [(None, 1, 1), (3, None, None)]
    got = filter_urls(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ).collect()
    assert all(r.verdict == ("block" if r.page_id % 2 else "allow") and (r.mined > 0) == bool(r.page_id % 2) for r in got)


def test_sql_twin(spark):
    sf = "/root/testdata/sf0.01"
    pages, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "labels"))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLES["op3_url_filter"]).fetchall()
    got = filter_urls(pages, labels).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_rules_of_any_length(spark):
    import random

    # Only all of a to d together are mostly bad; e and f are bad on their own.
    rows = [(list("abcd"), True)] * 8 + [([t for t in "abcd" if t != out], False) for out in "abcd" for _ in range(8)]
    rows += [(list("efgh") + ["i"], True)] * 8 + [(list("klmnop"), True)] * 6 + [([t for t in "klmnop" if t != out], False) for out in "klmnop" for _ in range(6)]
    rng = random.Random(9)
    rows += [(sorted(rng.sample("qrstuv", rng.randint(3, 6))), rng.random() < 0.5) for _ in range(120)]
    got, _ = mined(spark, rows)
    got = {k: v[:2] for k, v in got.items()}
    assert got == rules_by_counting(rows, 0.6) and ("a", "b", "c", "d") in got and tuple("klmnop") in got


def test_long_rule_blocks_pages(spark):
    urls = ["x://bad.net/ads/banner", "x://bad.net/ads", "x://bad.net/banner", "x://good.net/ads/banner", "x://bad.org2/ads/banner"]
    pages = [(i, urls[0] if i % 5 == 0 else urls[i % 5]) for i in range(60)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(40)]
    got = filter_urls(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ).collect()
    assert all(r.verdict == ("block" if r.page_id % 5 == 0 else "allow") for r in got)


def test_every_rule_counts(spark):
    import random

    # a and b always stand together where there are labels, also as parts of longer rules; c is a rule alone, d and e only together.
    rng = random.Random(3)
    paths = ["a/b/c", "a/b", "a/b/d/e", "d", "e", "c/d", "c/d/e", "f"]
    pages = [(i, paths[i % 8]) for i in range(160)] + [(200 + i, "/".join(rng.sample("abcdef", rng.randint(1, 6)))) for i in range(40)]
    bad = lambda p: "c" in p or ("d" in p and "e" in p) or rng.random() < 0.3
    labels = [(i, int(not bad(p)), 0) for i, p in pages[:160]]
    frames = spark.createDataFrame([(i, f"x://h/{p}") for i, p in pages], "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.mined) for r in filter_urls(*frames).collect()}

    tokens = {i: frozenset(["s:x", "h:h", *(f"p:{x}" for x in p.split("/"))]) for i, p in pages}
    known = [(tokens[i], quality == 0) for i, quality, _ in labels]
    every = set()
    for c in {c for t, _ in known for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}:
        has = [b for t, b in known if set(c) <= t]
        if sum(has) >= 5 and sum(has) / len(has) >= 0.6:
            every.add(c)
    want = {i: sum(set(c) <= t for c in every) for i, t in tokens.items()}
    assert got == {i: ("block" if n else "allow", n) for i, n in want.items()} and max(want.values()) > 20


def test_rules_beyond_a_long(spark):
    long = "x://h/" + "/".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70))
    pages = [(i, long if i < 10 else "x://h/p" if i < 40 else "y://g/q") for i in range(50)]
    labels = [(i, int(i >= 10), 0) for i in range(50)]
    frames = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert all((r.verdict, r.mined) == (("block", 2**63 - 1) if r.page_id < 10 else ("allow", 0)) for r in filter_urls(*frames).collect())
