import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioseek.llm.exact_dedup import exact_dedup

TEXTS = [
    (1, "ab" * 40), (2, "ab" * 40), (3, ""), (4, None), (5, "a"), (6, "ab" * 39 + "a"), (7, "ba" * 40),
    (8, "😀é" * 25), (9, "😀é" * 25), (9, "😀é" * 25), (None, "a"), (None, "zz"), (10, "line\nline\n" * 9), (11, "x" * 5000), (12, "x" * 5000),
    (13, "x" * 4999), (14, "a\0"),
]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        out.append((i, max(ids, default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("key", [lambda c: F.xxhash64(c), lambda c: F.length(c).cast("long"), lambda c: F.lit(1).cast("long")])
@pytest.mark.parametrize("block", [3, 64])
def test_matches_grouping_by_text(spark, key, block):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("name", F.lit(0))
    got = exact_dedup(docs, block=block, key=key).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.text_sha256) for r in got) == sorted(
        (a or -1, b or -1, n, s) for a, b, n, s in expected(TEXTS)
    )
    stays = defaultdict(int)
    for r in got:
        stays[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(stays.values()) == {1}
    assert len({(r.blocks, r.name) for r in got}) == len(stays)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
