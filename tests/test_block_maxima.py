import random

import pytest
from pyspark.sql import functions as F

from folioseek import Field, IndexSpec
from folioseek.operators import block_maxima
from folioseek.operators.paging import Page
from folioseek.operators.sorting import RELEVANCE, Sort
from folioseek.plans import search
from folioseek.plans.collection import Collection
from folioseek.sources import readers

SPEC = IndexSpec.of("b", [Field("id", "i64", pk=True), Field("text")])


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    pick = lambda n: rng.choices(words, [1 / (i + 1) for i in range(400)], k=n)
    texts = [" ".join(pick(rng.randint(1, 120))) for _ in range(1500)]
    texts += texts[:40] * 2 + [texts[7]] * 30  # equal scores
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    c = Collection(spark, str(tmp_path_factory.mktemp("b") / "c"), SPEC, buckets=4)
    c.build(readers.from_table(docs), unique=True)
    asked = [(i, texts[i]) for i in range(25)] + [(100, "w0"), (101, "w0 w1"), (102, "w399"), (103, "none"), (104, "w0 none w398 w1 w2 w3"), (105, texts[7])]
    queries = spark.createDataFrame(asked, "qid long, t string").select(
        "qid", F.array(F.struct(F.lit(None).cast("string").alias("field"), F.col("t").alias("text"), F.lit("should").alias("occur"))).alias("clauses")
    )
    return c, queries


@pytest.mark.parametrize("page,small", [(Page.of(1, 10), True), (Page.of(3, 7), False), (Page.of(1, 1), True)])
def test_same_page_as_scoring_everything(index, monkeypatch, page, small):
    c, queries = index
    if not small:
        for name in ("SMALL_BATCH", "FEW_ROWS"):
            monkeypatch.setattr(search, name, 0)
    monkeypatch.setattr(search, "MANY_HITS", 1 << 60)
    plain = c.search(queries, sort=[Sort(RELEVANCE)], page=page)
    want = sorted(plain.page_ids.collect())
    assert plain.leaders is None
    monkeypatch.setattr(search, "MANY_HITS", 1)
    pruned = c.search(queries, sort=[Sort(RELEVANCE)], page=page)
    assert sorted(pruned.page_ids.collect()) == want and len(want) > 20
    everything = plain._hits.count()
    assert sum(h.count() for h in pruned.leaders.hits) * 1.5 < everything


def test_when_it_is_not_used(index, monkeypatch):
    c, queries = index
    monkeypatch.setattr(search, "MANY_HITS", 1)
    for options in (dict(sort=[Sort(RELEVANCE, "asc")]), dict(sort=[Sort("id")]), dict(sort=[Sort(RELEVANCE)], max_proximity=2)):
        assert c.search(queries, page=Page.of(1, 3), **options).leaders is None
    c.append(readers.from_table(c.spark.createDataFrame([(1, "w0")], "id long, text string")))
    assert c.search(queries, sort=[Sort(RELEVANCE)]).leaders is None
    c.compact()
    assert c.search(queries, sort=[Sort(RELEVANCE)]).leaders is not None


def test_shares_by_block(index):
    c, _ = index
    t = c.tables()
    n, mean = t.corpus.first()
    blocks = {(r.scope, r.token, r.block): r.top for r in t.blocks.collect()}
    tops = {(r.scope, r.token): r.top for r in t.stats.collect()}
    seen = set()
    for r in t.postings.withColumn("block", block_maxima.block_of(n)).collect():
        share = r.tf * 2.2 / (r.tf + 1.2 * (0.25 + 0.75 * r.dl / mean))
        assert share <= tops[r.scope, r.token] + 1e-12
        if (r.scope, r.token, r.block) in blocks:
            assert share <= blocks[r.scope, r.token, r.block] + 1e-12
            seen.add((r.scope, r.token, r.block))
    assert seen == set(blocks)
