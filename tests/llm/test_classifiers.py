import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioseek.llm import language, quality
from folioseek.llm.language import LanguageModel, codewords, decode, fit_languages, ngram_frequencies, predict_languages
from folioseek.llm.quality import BITS, WordFeatures, fit_quality, ftrl, score_quality

SF = "/root/testdata/sf0.01"


def out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 30])
def test_codewords_differ(n):
    code = codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert code.shape[0] == n and min(apart, default=1) >= 1
    if n >= 9:
        assert min(apart) > code.shape[1] / 5


def test_pieces_of_long_texts_give_the_same_features(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abçdé!1") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    whole, words = ngram_frequencies(text), WordFeatures().of(text)
    monkeypatch.setattr(language, "_PIECE", 101)
    monkeypatch.setattr(quality, "_PIECE", 97)
    assert np.allclose(whole, ngram_frequencies(text))
    pieces = WordFeatures().of(text)
    assert (words[0] == pieces[0]).all() and np.allclose(words[1], pieces[1])


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = predict_languages(docs, fit_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == out(r.doc_id) for r in got)
    unseen = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in unseen]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_edge_rows(spark):
    rows = [(i, "the of and " * 5, "en") for i in range(30)] + [(i, "der die und " * 5, "de") for i in range(30, 60)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 !?", "de"), (None, "der und", None), (7, "the of and", None), (7, "the of and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = predict_languages(docs, fit_languages(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (100, 101, 102))
    assert by[None].lang_pred == "de" and by[None].held_out is False and by[7].lang_pred == "en"
    one = docs.filter("lang = 'en'")
    assert {r.lang_pred for r in predict_languages(docs.filter("doc_id < 40"), fit_languages(one)).collect()} == {"en"}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in predict_languages(none, fit_languages(none)).collect()} == {"und"}
    assert predict_languages(docs.limit(0), fit_languages(docs)).count() == 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    w = fit_quality(docs, labels)
    got = score_quality(docs, w).collect()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    unseen = [r for r in got if r.held_out and r.doc_id in marks]
    assert all(r.held_out == out(r.doc_id) and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == marks[r.doc_id] for r in unseen]) > 0.95


def test_quality_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(1))
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 0), (3, 1), (99, 1)], "doc_id long, quality int")
    got = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    got = score_quality(docs, fit_quality(docs, labels.limit(0))).collect()
    assert {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    assert score_quality(docs.limit(0), np.zeros((1 << 18) + 1, np.float32)).count() == 0


def test_ftrl_steps_one_coordinate_at_a_time():
    rng = np.random.default_rng(9)
    rows = [(np.sort(rng.choice(1 << BITS, 6, replace=False)) % 50, rng.random(6), int(rng.integers(2))) for _ in range(40)]
    rows = [(*(lambda i, at: (i, x[at]))(*np.unique(i, return_index=True)), y) for i, x, y in rows]
    alpha, beta, l1, l2 = 0.7, 1.1, 0.02, 0.3
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(2)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            index, value, y = rows[k]
            x = {**{int(i): float(v) for i, v in zip(index, value)}, 1 << BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = ftrl(rows, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    want = np.zeros((1 << BITS) + 1)
    for i in z:
        want[i] = weight(i)
    assert np.allclose(got, want, atol=1e-6) and (want != 0).sum() > 20


def test_scores_are_plain_sums(spark):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(1 << BITS) + 1).astype(np.float32)
    texts = ["one two, two THREE 4", "", None, "x " * 3000, "a b\tc\nd é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_quality(docs, w).collect()}
    for i, t in enumerate(texts):
        index, value = WordFeatures().of(t or "")
        total = float(w[-1]) + sum(float(w[k]) * float(v) for k, v in zip(index, value))
        assert math.isclose(got[i], 1 / (1 + math.exp(-total)), rel_tol=1e-5)


def test_decoding_bit_by_bit():
    rng = np.random.default_rng(6)
    code = codewords(7)
    x, w = rng.normal(size=(30, 11)), rng.normal(size=(12, code.shape[1]))
    trust = rng.random(code.shape)
    trust /= trust.sum(axis=1, keepdims=True)
    cost, sure = decode(x, w, code, trust)
    model = LanguageModel([f"l{i}" for i in range(7)], code, w, trust)
    best, score, lead, near, _ = model.predict(x)
    for r in range(30):
        f = [sum(x[r, j] * w[j, b] for j in range(11)) + w[11, b] for b in range(code.shape[1])]
        want = [sum(trust[i, b] * math.log1p(math.exp(-code[i, b] * f[b])) for b in range(len(f))) for i in range(7)]
        assert np.allclose(cost[r], want) and math.isclose(sure[r], sum(map(abs, f)) / len(f))
        first, second = sorted(want)[:2]
        assert best[r] == want.index(first) and math.isclose(near[r], first) and math.isclose(lead[r], second - first, abs_tol=1e-9)
        assert math.isclose(score[r], 1 / sum(math.exp(-(c - first) * len(f)) for c in want))
