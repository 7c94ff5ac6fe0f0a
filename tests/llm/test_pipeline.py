import re

from pyspark.sql import functions as F

import corpus_pipeline
from folioseek.llm.language import fit_languages, predict_languages
from folioseek.llm.shingles import shingle_set
from folioseek.session import staged

SF = "/root/testdata/sf0.001"


def brute_near(rows):
    """Ids that stay of (id, text): the least of each component of 5-word sets with J >= 0.8."""
    sets = [shingle_set(t.encode(), 5) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, "en", "src0", 0), (9002, "", None, None, 0), (9003, "123 !!", "en", "src1", 6), (9004, "the and of was", None, None, 14)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("kept", F.lit("clash"))
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    left = staged(stages["language"](spark, docs, SF), "t")
    assert left.columns == columns
    before = {r.doc_id: r.text for r in docs.collect()}
    lettered = {i for i, t in before.items() if t and re.search(r"[^\W\d_]", t)}
    far = {r.doc_id for r in predict_languages(docs, fit_languages(docs)).filter("distance > 0.6").collect()}
    assert lettered - far <= {r.doc_id for r in left.collect()} <= lettered

    once = staged(stages["exact dedup"](spark, left, SF), "t")
    last = {}
    for r in left.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(last.values())

    apart = staged(stages["near dedup"](spark, once, SF), "t")
    assert sorted(r.doc_id for r in apart.collect()) == brute_near([(r.doc_id, r.text) for r in once.collect()])

    mixed = staged(stages["mixing"](spark, apart, SF), "t")
    assert mixed.columns == columns
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(size(mixed.collect()) / size(apart.collect()) - 1.5) < 0.1
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2

    plan = stages["packing"](spark, mixed, SF)
    assert sorted(r.doc_id for r in plan.collect()) == sorted(r.doc_id for r in mixed.collect())


def test_language_stage_decides_by_the_codes(spark):
    import random

    rng = random.Random(1)
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = known.filter("length(text) > 1500").groupBy("lang").agg(F.collect_list("text").alias("t")).collect()
    mixed = [(100_000 + i, " ".join(r.t[i][:600] for r in texts if r.lang not in skip)) for i, skip in enumerate([(), ("de",), ("en",), ("fr", "es")])]
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    junk = [(200_000, " ".join(letters(rng.randint(3, 9), "abcdefghijklmnopqrstuvwxyz") for _ in range(500))), (200_001, letters(3_000, "abcdefghijkLMNOPQRSTUvwxyz0123456789"))]
    docs = known.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, None) for i, t in mixed + junk], "doc_id long, text string, lang string"))
    stage = dict(corpus_pipeline.STAGES)["language"]
    left = {r.doc_id for r in stage(spark, docs, SF).collect()}
    assert {i for i, _ in mixed} <= left and not {i for i, _ in junk} & left
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert stage(spark, unlabelled, SF).count() == docs.filter(r"text RLIKE '\\p{L}'").count()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
