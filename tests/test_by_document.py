import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioseek import Field, IndexSpec
from folioseek.operators import by_document
from folioseek.operators.paging import Page
from folioseek.operators.sorting import RELEVANCE, Sort
from folioseek.plans import search
from folioseek.plans.collection import Collection
from folioseek.sources import readers

SPEC = IndexSpec.of("b", [Field("id", "i64", pk=True), Field("text")])


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(200)], k=rng.randint(1, 60))) for _ in range(500)]
    texts += texts[:20] * 2 + [texts[7]] * 30  # equal scores
    c = Collection(spark, str(tmp_path_factory.mktemp("d") / "c"), SPEC, buckets=4)
    c.build(readers.from_table(spark.createDataFrame(list(enumerate(texts)), "id long, text string")), unique=True)
    asked = [(i, texts[i]) for i in range(25)] + [(25, "none"), (26, ""), (27, texts[7]), (3, "w0 w5"), (None, "w1 w2"), (None, "w3")]
    queries = spark.createDataFrame(asked, "qid long, t string").select(
        "qid", F.array(F.struct(F.lit(None).cast("string").alias("field"), F.col("t").alias("text"), F.lit("should").alias("occur"))).alias("clauses")
    )
    return c, queries


def pages(index, page, sort=(Sort(RELEVANCE),)):
    c, queries = index
    s = c.search(queries, sort=sort, page=page)
    return s, sorted(((r.qid is None, r.qid or 0, r["rank"]), r.docid, r.score) for r in s.page_ids.collect())


@pytest.mark.parametrize("page,small", [(Page.of(1, 5), True), (Page.of(3, 7), False)])
def test_same_page_as_scoring_in_rows(index, monkeypatch, page, small):
    plain, want = pages(index, page)
    assert plain.shared is None and plain.leaders is None and len(want) > 100
    monkeypatch.setattr(search, "MANY_SHARED", 1)
    for name, value in {"_WEIGHTS": 1000, "_STEP": 300, "_PENDING": 50}.items():
        monkeypatch.setattr(by_document, name, value)
    if not small:
        monkeypatch.setattr(search, "SMALL_BATCH", 0)
    shared, got = pages(index, page)
    assert shared.shared is not None
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 2e-9 for a, b in zip(got, want))


def test_when_it_is_not_used(index, monkeypatch):
    c, queries = index
    monkeypatch.setattr(search, "MANY_SHARED", 1)
    used = lambda queries, **options: c.search(queries, **{"sort": [Sort(RELEVANCE)], **options}).shared is not None
    assert used(queries) and not used(queries, sort=[Sort(RELEVANCE, "asc")]) and not used(queries, max_proximity=2)
    assert not used(queries.filter("qid = 1"))  # no posting is asked for twice
    monkeypatch.setattr(search, "FEW_ROWS", 100)
    assert not used(queries)


def test_documents_cut_by_batches():
    rng = random.Random(1)
    rows = [(f"d{d:03}", t, rng.random()) for d in range(40) for t in range(rng.choice([1, 1, 2, 9]))]
    for size in (1, 2, 3, 7, 1000):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_pydict({"docid": [r[0] for r in b], "tid": pa.array([r[1] for r in b], pa.int32()), "share": [r[2] for r in b]}) for b in [[], *cut] if b]
        got = [
            (name, t, s)
            for names, starts, tids, shares in by_document.documents(iter(batches))
            for name, ts, ss in zip(names, np.split(tids, starts[1:]), np.split(shares, starts[1:]))
            for t, s in zip(ts.tolist(), ss.tolist())
        ]
        assert got == rows
