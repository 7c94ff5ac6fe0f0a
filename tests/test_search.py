import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from folioseek import Field, IndexSpec
from folioseek.operators import postings as P
from folioseek.operators import paging, proximity, retrieve, survivors
from folioseek.operators.filters import Filter, predicate
from folioseek.operators.paging import Page
from folioseek.operators.sorting import RELEVANCE, Sort
from folioseek.operators.typed import accepted, typed_read
from folioseek.plans import search as search_plan
from folioseek.plans.search import Search, Tables, query_frame
from folioseek.sources.readers import from_table

SPEC = IndexSpec.of(
    "d",
    [
        Field("id", "i64", pk=True),
        Field("title"),
        Field("body", tokenizer="zh"),
        Field("tag", tokenizer="none"),
        Field("n", "i32"),
    ],
)
WORDS = ["a", "b", "c", "d", "e", "f", "g"]
RNG = random.Random(3)
DOCS = [
    (
        i,
        " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(0, 4))) or None,
        " ".join(RNG.choice(WORDS + ["世界"]) for _ in range(RNG.randint(0, 6))),
        RNG.choice(["x", "y"]),
        RNG.choice([None, -3, -1, 0, 2, 5]),
    )
    for i in range(60)
]


def plain_tokens(doc):
    """Field name -> tokens; the words hold no punctuation."""
    body = [t for w in doc[2].split() for t in (list(w) if w == "世界" else [w])]
    return {"title": (doc[1] or "").split(), "body": body}


@pytest.fixture(scope="module")
def tables(spark):
    raw = spark.createDataFrame(DOCS, "id bigint, title string, body string, tag string, n int")
    docs = accepted(typed_read(from_table(raw), SPEC)).select("docid", "doc").cache()
    posted = P.postings(docs, SPEC).cache()
    lengths = P.doc_lengths(docs, SPEC)
    return Tables(docs, posted, P.token_stats(posted), P.corpus_stats(lengths))


def expected_postings():
    out = {}
    for d in DOCS:
        start = 0
        for field, toks in plain_tokens(d).items():
            for i, t in enumerate(toks):
                out.setdefault((str(d[0]), "", t), []).append(start + i)
                out.setdefault((str(d[0]), field, t), []).append(start + len(toks) + i)
            if toks:
                start += 2 * len(toks) + 10
    return out


def test_postings_and_positions(tables):
    rows = tables.postings.collect()
    got = {(r.docid, r.scope, r.token): list(r.positions) for r in rows}
    assert len(got) == len(rows) and got == expected_postings()
    assert all(r.tf == len(r.positions) for r in rows)


def test_single_scope_postings(tables):
    for scopes, keep in (("global", lambda s: s == ""), ("field", lambda s: s != "")):
        got = {(r.docid, r.scope, r.token): list(r.positions) for r in P.postings(tables.docs, SPEC, scopes).collect()}
        assert got == {k: v for k, v in expected_postings().items() if keep(k[1])}


QUERIES = [
    (1, [(None, "a b", "should")]),
    (2, [(None, "a", "must"), (None, "b", "should")]),
    (3, [(None, "a b", "must"), ("title", "c", "must_not")]),
    (4, [("body", "世界", "must")]),
    (5, [(None, "g", "must_not")]),
    (6, [("title", "a", "must_not"), (None, "b", "must_not")]),
    (7, []),
    (8, [(None, "zzz", "must"), (None, "a", "should")]),
    (9, [(None, "zzz", "should")]),
    (10, [("tag", "x", "must")]),  # analysed by none: the clause drops out
    (11, [("n", "5", "must")]),  # a number field holds no tokens
    (12, [("nope", "a", "must"), (None, "f", "should"), (None, " ,; ", "must")]),
    (13, [(None, "zzz", "must_not")]),
    (14, [(None, "a", "should"), ("title", "a", "should"), (None, "a", "must_not")]),
    (15, [(None, "a b c d e f g", "must_not")]),
]


def expected_matches(clauses):
    """docid -> score for positive queries; a set of docids otherwise."""
    roles = {"should": set(), "must": set(), "must_not": set()}
    for field, text, occur in clauses:
        if field is not None and field not in ("title", "body", "n"):
            continue
        toks = [t for w in text.replace(",", " ").replace(";", " ").split() for t in (list(w) if w == "世界" else [w])]
        roles[occur] |= {(field or "", t) for t in toks}
    posted = expected_postings()
    by_doc, df = {}, {}
    for (docid, scope, token), places in posted.items():
        by_doc.setdefault(docid, {})[(scope, token)] = len(places)
        df[(scope, token)] = df.get((scope, token), 0) + 1
    lens = {str(d[0]): sum(len(t) for t in plain_tokens(d).values()) for d in DOCS}
    n, avg = len(DOCS), sum(lens.values()) / len(DOCS)
    out = {}
    for docid in lens:
        have = by_doc.get(docid, {})
        if any(t in have for t in roles["must_not"]):
            continue
        if not all(t in have for t in roles["must"]):
            continue
        positive = roles["should"] | roles["must"]
        if positive and not roles["must"] and not any(t in have for t in roles["should"]):
            continue
        score = 0.0
        for t in positive:
            if t in have:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                score += idf * have[t] * 2.2 / (have[t] + 1.2 * (0.25 + 0.75 * lens[docid] / avg))
        out[docid] = score
    return out


@pytest.fixture(params=["small", "large", "large-hot", "no-stats"])
def mode(request, monkeypatch):
    if request.param.startswith("large"):
        monkeypatch.setattr(search_plan, "SMALL_BATCH", 0)
    if request.param == "large-hot":
        # Every token counts as hot and is split.
        original = retrieve.hot_tokens
        monkeypatch.setattr(retrieve, "hot_tokens", lambda stats, *a: original(stats, 3))
    monkeypatch.setattr(survivors, "BLOCK", 4)
    if request.param in ("small", "large-hot"):
        monkeypatch.setattr(survivors, "DENSE", 0)  # every token has bitmaps of its own
    return request.param


def test_excluded_positions_over_several_bitmaps(spark):
    n = 100_000
    placed = spark.range(n).selectExpr("string(id) AS docid", "id AS pos")
    held = {"all": lambda i: True, "most": lambda i: i % 3 > 0, "half": lambda i: i >= 40_000, "few": lambda i: i in (0, 32_767, 32_768, 99_999)}
    when = {"all": "true", "most": "id % 3 > 0", "half": "id >= 40000", "few": "id IN (0, 32767, 32768, 99999)"}
    posted = None
    for t, c in when.items():
        rows = spark.range(n).filter(c).selectExpr("'' AS scope", f"'{t}' AS token", "string(id) AS docid")
        posted = rows if posted is None else posted.unionByName(rows)
    asked = {1: ["most"], 2: ["half"], 3: ["few"], 4: ["most", "few"], 5: ["half", "most", "few"], 6: ["all"]}
    df = {t: sum(map(has, range(n))) for t, has in held.items()}
    barring = spark.createDataFrame([(q, "", t, df[t]) for q, ts in asked.items() for t in ts] + [(3, "", "none", None)], "qid long, scope string, token string, df long")
    for page in (Page(1, 20), Page(1100, 10), Page(2001, 20)):
        bits = survivors.excluded_bits(barring, posted, placed, n, True)
        got = {}
        for r in survivors.surviving_page(bits, placed, page).collect():
            got.setdefault(r.qid, {})[r.rank] = int(r.docid)
        for q, ts in asked.items():
            want = [i for i in range(n) if not any(held[t](i) for t in ts)][page.offset : page.end]
            assert got.get(q, {}) == {page.offset + 1 + i: d for i, d in enumerate(want)}


def test_search_against_brute_force(spark, tables, mode):
    used = Tables(tables.docs, tables.postings, None, tables.corpus) if mode == "no-stats" else tables
    page = Page(2, 7)
    s = Search(used, SPEC, query_frame(spark, QUERIES), sort=[Sort(RELEVANCE)], page=page)
    matches = {}
    for r in s.matches.collect():
        matches.setdefault(r.qid, {})[r.docid] = r.score
    pages = {}
    for r in s.page_ids.collect():
        pages.setdefault(r.qid, {})[r.rank] = r.docid
    figures = {r.qid: r for r in s.summary.collect()}
    assert set(figures) == {q for q, _ in QUERIES}
    for qid, clauses in QUERIES:
        want = expected_matches(clauses)
        if qid in matches:
            assert matches[qid].keys() == want.keys(), qid
            assert all(abs(matches[qid][d] - want[d]) < 1e-6 for d in want), qid
        f = figures[qid]
        assert f.total == len(want), qid
        assert f.pages == -(-len(want) // 7) and f.page_size == 7 and f.curr_page == 2
        order = sorted(want, key=lambda d: (-round(want[d], 9), d))
        cut = order[page.offset : page.end]
        assert [pages.get(qid, {}).get(i + 8) for i in range(len(cut))] == cut, qid
        assert len(pages.get(qid, {})) == len(cut) == f.page_count, qid


def test_filters_apply_to_every_kind_of_query(spark, tables, monkeypatch):
    monkeypatch.setattr(survivors, "BLOCK", 4)
    s = Search(
        tables, SPEC, query_frame(spark, QUERIES), filters=[Filter("tag", ["x"]), Filter("n", ranges=[(-1, None)])],
        sort=[Sort("n", "asc"), Sort("id", "desc")], page=Page(1, 100), fields=["id", "n"],
    )
    kept = {str(d[0]): d for d in DOCS if d[3] == "x" and d[4] is not None and d[4] >= -1}
    got = {}
    for r in s.page.collect():
        got.setdefault(r.qid, []).append((r["rank"], r.docid, r.n))
    totals = {r.qid: r.total for r in s.totals.collect()}
    for qid, clauses in QUERIES:
        want = sorted((d for d in expected_matches(clauses) if d in kept), key=lambda d: (kept[d][4], -kept[d][0]))
        assert [d for _, d, _ in sorted(got.get(qid, []))] == want, qid
        assert totals[qid] == len(want)


def test_must_is_within_should(spark, tables):
    words = ["a b", "c", "d e f"]
    q = [(i, [(None, w, "should")]) for i, w in enumerate(words)] + [(10 + i, [(None, w, "must")]) for i, w in enumerate(words)]
    s = Search(tables, SPEC, query_frame(spark, q), sort=[Sort(RELEVANCE)])
    rows = s.matches.collect()
    hits = lambda qid: {r.docid for r in rows if r.qid == qid}
    for i in range(len(words)):
        assert hits(10 + i) <= hits(i)


def test_default_and_string_sorts(spark, tables):
    q = query_frame(spark, [(1, [(None, "a b", "should")]), (2, [])])
    by_id = Search(tables, SPEC, q, page=Page(1, 5)).page.filter("qid = 2").orderBy("rank").collect()
    assert [r.id for r in by_id] == [0, 1, 2, 3, 4]
    rows = Search(tables, SPEC, q, sort=[Sort("title"), Sort("nope"), Sort("id", "asc")], page=Page(1, 100)).page.filter("qid = 1").orderBy("rank").collect()
    want = expected_matches(QUERIES[0][1])
    titles = {str(d[0]): d[1] for d in DOCS}
    order = sorted(want, key=lambda d: (titles[d] is None, -math.floor(round(want[d], 9)) if titles[d] is not None else 0, int(d)))
    assert [r.docid for r in rows] == order
    text = Search(tables, SPEC, q, sort=[Sort("title", "asc", as_text=True)], page=Page(1, 100)).page.filter("qid = 2").orderBy("rank").collect()
    assert [r.docid for r in text] == sorted(titles, key=lambda d: (titles[d] is None, titles[d] or "", d))


def test_missing_values_sort_last(spark, tables):
    q = query_frame(spark, [(1, [])])
    for direction, sign in (("asc", 1), ("desc", -1)):
        rows = Search(tables, SPEC, q, sort=[Sort("n", direction)], page=Page(1, 100)).page.orderBy("rank").collect()
        ns = {str(d[0]): d[4] for d in DOCS}
        assert [r.docid for r in rows] == sorted(ns, key=lambda d: (ns[d] is None, sign * (ns[d] or 0), d))


def test_page_arguments():
    assert Page.of() == Page(1, 20) and Page.of("3", "5") == Page(3, 5)
    assert Page.of("x", "y") == Page(1, 20) and Page.of(0, 0) == Page(1, 20) and Page.of(-1, 1000) == Page(1, 100)


def test_unknown_output_field_fails_before_any_job(spark, tables):
    with pytest.raises(ValueError, match="no field nope"):
        Search(tables, SPEC, query_frame(spark, QUERIES), fields=["nope"])


def test_deep_ranks_use_two_steps(spark):
    df = spark.range(5000).select(F.lit(1).alias("qid"), F.col("id").cast("string").alias("docid"), (F.col("id") % 97).alias("k"))
    got = paging.top_per_group(df, ["qid"], [F.desc("k"), F.asc("docid")], 2000).collect()
    order = sorted((str(i) for i in range(5000)), key=lambda d: (-(int(d) % 97), d))[:2000]
    assert [r.docid for r in sorted(got, key=lambda r: r["rank"])] == order


def brute_spread(chain):
    return min(sum(abs(b - a - 1) for a, b in zip(p, p[1:])) for p in itertools.product(*chain))


def test_proximity_against_brute_force(spark, tables):
    clauses = [(1, [(None, "a b", "must")]), (2, [(None, "c a b", "must"), (None, "d e", "should")])]
    ordered = retrieve.clause_tokens(query_frame(spark, clauses), SPEC)
    got = {(r.qid, r.docid, r.cno): r.proximity for r in proximity.proximity(ordered, tables.postings).collect()}
    posted = expected_postings()
    want = {}
    for qid, cs in clauses:
        for cno, (_, text, _) in enumerate(cs):
            for d in DOCS:
                chain = [posted.get((str(d[0]), "", t)) for t in text.split()]
                if all(chain):
                    want[(qid, str(d[0]), cno)] = brute_spread(chain)
    assert got == want
    s = Search(tables, SPEC, query_frame(spark, clauses[:1]), sort=[Sort(RELEVANCE)], max_proximity=2)
    assert {r.docid for r in s.matches.collect()} == {d for (q, d, _), v in want.items() if q == 1 and v <= 2}


def test_small_batches_prune_and_broadcast(spark, tables):
    s = Search(tables, SPEC, query_frame(spark, QUERIES[:1]), sort=[Sort(RELEVANCE)])
    plan = s.matches._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan


FILTER_SPEC = IndexSpec.of(
    "f",
    [
        Field("id", "i64", pk=True), Field("n", "i32"), Field("z", tokenizer="zh"), Field("w"), Field("raw", tokenizer="none"),
        Field("flag", "bool"), Field("at", "datetime"), Field("j", "json"),
    ],
)


@pytest.fixture(scope="module")
def filter_docs(spark):
    rows = [
        (0, 10, "世界很大", "red ring", " x ", True, "2020-01-01 00:00:00", '"red ring"'),
        (1, 13, "世", "reddish", "y", False, "2020-01-02 00:00:00", "7"),
        (2, 25, "", "'red ring' blue", "x y", None, None, '{"a":1}'),
        (3, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id bigint, n int, z string, w string, raw string, flag boolean, at string, j string")
    return accepted(typed_read(from_table(df.withColumn("j", F.parse_json("j"))), FILTER_SPEC)).cache()


@pytest.mark.parametrize(
    "filters,want",
    [
        ([Filter("n", ["10", "x", 25])], {0, 2}),
        ([Filter("n", ["x"])], {0, 1, 2, 3}),  # nothing usable is left
        ([Filter("nope", ["1"])], {0, 1, 2, 3}),
        ([Filter("n", [10], [("12", "15"), (20, None)])], set()),  # values and ranges must both hold
        ([Filter("n", [13], [("12", "15"), (20, None)])], {1}),
        ([Filter("n", [], [("12", "15"), ("", "10")])], {0, 1}),
        ([Filter("n", [], [("bad", "15"), (25, 25)])], {2}),
        ([Filter("n", [], [(None, None)])], {0, 1, 2, 3}),
        ([Filter("z", ["世"])], {0, 1}),
        ([Filter("z", [], [("", "世")])], {1, 2}),
        ([Filter("w", ["red"])], {0}),
        ([Filter("w", ["red ring"])], {2}),
        ([Filter("raw", ["x"])], {0}),
        ([Filter("flag", ["yes"])], {0}),
        ([Filter("flag", [], [("false", "true")])], set()),
        ([Filter("at", ["2020-01-02 00:00:00", "junk"])], {1}),
        ([Filter("at", [], [("2020-01-01 12:00:00", None)])], {1}),
        ([Filter("j", ["red"])], {0}),
        ([Filter("j", [7])], {1}),
        ([Filter("j", ["7"])], set()),
        ([Filter("n", [10, 13]), Filter("flag", [True])], {0}),
    ],
)
def test_filters(filter_docs, filters, want):
    p = predicate(filters, FILTER_SPEC)
    df = filter_docs if p is None else filter_docs.filter(p)
    assert {r.id for r in df.select("doc.id").collect()} == want


def test_filter_or_option(filter_docs):
    p = predicate([Filter("n", [10], [("12", "15")])], FILTER_SPEC, combine="or")
    assert {r.id for r in filter_docs.filter(p).select("doc.id").collect()} == {0, 1}


def test_filters_reach_the_scan(spark, filter_docs, tmp_path):
    path = str(tmp_path / "docs")
    filter_docs.write.parquet(path)
    df = spark.read.parquet(path).filter(predicate([Filter("n", ["10"], [("5", None)]), Filter("raw", ["x"])], FILTER_SPEC))
    plan = df.select("docid")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc.n,10)" in plan and "doc:struct<n:int,raw:string>" in plan


def test_json_sort_key(spark, filter_docs):
    docs = filter_docs.select("docid", "doc")
    posted = P.postings(docs, FILTER_SPEC)
    t = Tables(docs, posted, None, P.corpus_stats(P.doc_lengths(docs, FILTER_SPEC)))
    rows = Search(t, FILTER_SPEC, query_frame(spark, [(1, [])]), sort=[Sort("j")]).page.orderBy("rank").collect()
    # 7 by value, the string by its score (0 here), the object as 0, missing last
    assert [r.docid for r in rows] == ["1", "0", "2", "3"]
    hits = Search(t, FILTER_SPEC, query_frame(spark, [(1, [("j", "red", "must")])]), sort=[Sort(RELEVANCE)]).matches.collect()
    assert [r.docid for r in hits] == ["0"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_show_pages_without_shuffling_documents(spark, tables):
    s = Search(tables, SPEC, query_frame(spark, QUERIES), sort=[Sort(RELEVANCE)], page=Page.of(1, 3))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        shown = s.tables.docs.select("docid", F.col("doc").alias("whole"))
        plan = plan_of(shown.join(s._few_ids, "docid"))
        assert "BroadcastHashJoin" in plan
        documents = [line for line in plan.split("\n") if "whole" in line and "Exchange hashpartitioning" in line]
        assert not documents
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_plans_measure_proximity_without_python(spark, tables):
    s = Search(tables, SPEC, query_frame(spark, QUERIES), max_proximity=2)
    assert "Python" not in plan_of(s.matches) and "Pandas" not in plan_of(s.matches)


def test_must_queries_stage_no_positions(spark, tables, monkeypatch):
    written = []
    original = search_plan.staged
    monkeypatch.setattr(search_plan, "staged", lambda df, label: written.append(label) or original(df, label))
    monkeypatch.setattr(search_plan.survivors, "staged", lambda df, label: written.append(label) or original(df, label))
    for small in (True, False):
        if not small:
            monkeypatch.setattr(search_plan, "SMALL_BATCH", 0)
        s = Search(tables, SPEC, query_frame(spark, [(1, [(None, "the", "must")]), (2, [(None, "a", "must")])]))
        s.page_ids.collect(), s.totals.collect()
    assert set(written) <= {"weighted", "wanted"}
