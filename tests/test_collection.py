import json
import random

import pytest
from pyspark.sql import functions as F

from folioseek import Field, IndexSpec
from folioseek.operators import mutate
from folioseek.operators.sorting import RELEVANCE, Sort
from folioseek.operators.typed import KEY_MISSING, accepted, typed_read
from folioseek.plans.collection import Collection
from folioseek.plans.search import query_frame
from folioseek.sources import readers
from folioseek.streaming.ingest import ingest, json_lines_stream, table_stream

SPEC = IndexSpec.of("c", [Field("id", "u32", pk=True), Field("text"), Field("age", "i32"), Field("extra", "json")])


def rows(spark, items):
    lines = [json.dumps(x) for x in items]
    df = spark.createDataFrame(list(enumerate(lines)), "i bigint, value string")
    seq = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("source"), F.lit(0).cast("bigint").alias("block"), F.col("i").alias("pos"))
    return df.select(seq.alias("seq"), F.parse_json("value").alias("payload"), F.lit(None).cast("string").alias("error"))


def state(c):
    return {
        r.docid: (r.text, r.age, r.extra)
        for r in c.docs().select("docid", "doc.text", "doc.age", F.to_json("doc.extra").alias("extra")).collect()
    }


def found(spark, c, text):
    s = c.search(query_frame(spark, [(1, [(None, text, "should")])]), sort=[Sort(RELEVANCE)])
    return {r.docid: round(r.score, 6) for r in s.matches.collect()}


def fresh(spark, tmp_path, name, *builds):
    """The same content loaded at once: what a history of batches has to equal."""
    c = Collection(spark, str(tmp_path / name), SPEC, buckets=4)
    c.build(rows(spark, builds))
    return c


def test_life_of_a_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), SPEC, buckets=4)
    assert state(c) == {}
    c.append(rows(spark, [{"id": 1, "text": "old one"}, {"id": 2, "text": "two words", "age": 5, "extra": None}, {"id": "x"}, {"id": 1, "text": "new one"}]), 0, source="first")
    want = {"1": ("new one", None, None), "2": ("two words", 5, "null")}
    assert state(c) == want
    assert found(spark, c, "old") == {} and set(found(spark, c, "new words")) == {"1", "2"}
    report = c.report(0).orderBy("seq").collect()
    assert [r.docid for r in report] == ["1", "2", None, "1"] and "can not convert" in report[2].error
    s = c.summaries().first()
    assert (s.docs, s.failed, s.code) == (3, 1, 500)

    # The same batch again changes nothing.
    c.append(rows(spark, [{"id": 1, "text": "old one"}, {"id": 2, "text": "two words", "age": 5, "extra": None}, {"id": "x"}, {"id": 1, "text": "new one"}]), 0, source="first")
    assert state(c) == want

    before = found(spark, c, "new two")
    c.compact()
    assert state(c) == want and found(spark, c, "new two") == before
    c.compact()  # nothing to fold

    # A batch a snapshot has folded in is not applied again, and no other batch takes its number.
    assert c.append(rows(spark, [{"id": 9, "text": "late"}]), 0, source="first") is None
    with pytest.raises(ValueError, match="rise"):
        c.append(rows(spark, [{"id": 9, "text": "late"}]), 0)
    assert state(c) == want

    c.update(rows(spark, [{"id": 2, "age": 6}, {"id": 2, "text": "two things"}, {"id": 7, "age": 1}, {"id": 2, "age": 7}, {"age": 3}]), 1, source="second")
    want["2"] = ("two things", 7, "null")
    assert state(c) == want
    errors = [r.error for r in c.report(1).orderBy("seq").collect()]
    assert errors == [None, None, mutate.NOT_FOUND, None, KEY_MISSING]
    assert found(spark, c, "words") == {} and set(found(spark, c, "things")) == {"2"}
    c.update(rows(spark, [{"id": 2, "age": 6}, {"id": 2, "text": "two things"}, {"id": 2, "age": 7}]), source="second")
    assert state(c) == want

    c.append(rows(spark, [{"id": 3, "text": "three new"}, {"id": 1, "text": "one new new"}]), 2)
    c.delete(spark.createDataFrame([(2,), (2,), (99,)], "docid int"), 3)
    want = {"1": ("one new new", None, None), "3": ("three new", None, None)}
    assert state(c) == want
    once = fresh(spark, tmp_path, "once", {"id": 3, "text": "three new"}, {"id": 1, "text": "one new new"})
    assert found(spark, c, "new two three") == found(spark, once, "new two three")
    c.compact()
    assert state(c) == want and found(spark, c, "new two three") == found(spark, once, "new two three")
    excluding = c.search(query_frame(spark, [(1, [(None, "three", "must_not")])]))
    assert [r.docid for r in excluding.page_ids.collect()] == ["1"]


def test_no_batch_is_lost(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), SPEC, buckets=4)
    c.append(rows(spark, [{"id": 1, "text": "a"}]), 0)
    c.compact()
    for batch in (0, -1):
        with pytest.raises(ValueError, match="rise"):
            c.append(rows(spark, [{"id": 2, "text": "b"}]), batch)
    assert c.append(rows(spark, [{"id": 2, "text": "b"}])) == 1
    assert c.append(rows(spark, [{"id": 3, "text": "c"}]), source="s") == 2
    with pytest.raises(ValueError, match="rise"):
        c.append(rows(spark, [{"id": 4, "text": "d"}]), 2, source="t")
    with pytest.raises(ValueError, match="rise"):
        c.delete(spark.createDataFrame([(1,)], "docid int"), 1)
    assert c.append(rows(spark, [{"id": 4, "text": "d"}]), 7) == 7
    assert c.append(rows(spark, [{"id": 3, "text": "again"}]), source="s") is None
    assert set(state(c)) == {"1", "2", "3", "4"} and state(c)["3"][0] == "c"
    c.compact()
    assert c.append(rows(spark, [{"id": 3, "text": "again"}]), source="s") is None
    assert c.delete(spark.createDataFrame([(1,)], "docid int")) == 8
    assert set(state(c)) == {"2", "3", "4"}


def test_streams_with_checkpoints_of_their_own(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), SPEC, buckets=4)
    c.append(rows(spark, [{"id": 1, "text": "by hand"}]))
    for k in (2, 3):
        (tmp_path / f"in{k}").mkdir()
        (tmp_path / f"in{k}" / "a.jsonl").write_text('{"id": %d, "text": "stream"}\n' % k)
        ingest(json_lines_stream(spark, str(tmp_path / f"in{k}")), c, str(tmp_path / f"state{k}"), available_now=True).awaitTermination()
        c.compact()
    ingest(json_lines_stream(spark, str(tmp_path / "in2")), c, str(tmp_path / "state2"), available_now=True).awaitTermination()
    assert set(state(c)) == {"1", "2", "3"} and c.summaries().count() == 3


def test_unfinished_batches_are_not_seen(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), SPEC, buckets=4)
    c.append(rows(spark, [{"id": 1, "text": "a"}]), 0)
    # A batch that got as far as its documents but not to its summary.
    typed = accepted(typed_read(rows(spark, [{"id": 2, "text": "b"}]), SPEC))
    c._with_length(typed.select("docid", F.lit("U").alias("op"), "doc")).write.parquet(str(tmp_path / "c/log/docs/batch=1"))
    assert set(state(c)) == {"1"}
    c.append(rows(spark, [{"id": 3, "text": "c"}]), 1)
    assert set(state(c)) == {"1", "3"}


def test_bucket_count_is_remembered(spark, tmp_path):
    c = fresh(spark, tmp_path, "c", {"id": 1, "text": "a"})
    with pytest.raises(ValueError, match="buckets"):
        Collection(spark, c.path, SPEC, buckets=8)
    with pytest.raises(ValueError, match="already"):
        c.build(rows(spark, []))


def test_lookup_and_collisions(spark):
    spec = IndexSpec.of("k", [Field("a", pk=True), Field("b", "i16", pk=True), Field("v")])
    raw = spark.createDataFrame([("x", 1, "p"), ("y", 2, "q"), ("x", None, "r")], "a string, b int, v string")
    typed = typed_read(readers.from_table(raw), spec)
    keys = spark.createDataFrame([("2", "y"), ("1", "x"), ("5", "x")], "b string, a string")
    got = mutate.lookup(keys, accepted(typed), spec).select("docid", "doc.v").collect()
    assert {(r.docid, r.v) for r in got} == {("y_2", "q"), ("x_1", "p")}
    with pytest.raises(ValueError, match="missing"):
        mutate.docid_of(keys.select("a"), spec)
    clash = IndexSpec.of("k", [Field("a", pk=True), Field("b", pk=True)])
    raw = spark.createDataFrame([("a_b", "c"), ("a", "b_c"), ("a", "b"), ("a", "b")], "a string, b string")
    assert [r.docid for r in mutate.docid_collisions(typed_read(readers.from_table(raw), clash), clash).collect()] == ["a_b_c"]


def test_collisions_of_a_batch(spark, tmp_path):
    spec = IndexSpec.of("k", [Field("a", pk=True), Field("b", pk=True)])
    c = Collection(spark, str(tmp_path / "c"), spec, buckets=2)
    c.append(readers.from_table(spark.createDataFrame([("a_b", "c"), ("p", "q")], "a string, b string")))
    c.append(readers.from_table(spark.createDataFrame([("a", "b_c"), ("p", "q"), ("x_y", "z"), ("x", "y_z")], "a string, b string")))
    assert c.collisions(0).count() == 0
    assert sorted(r.docid for r in c.collisions(1).collect()) == ["a_b_c", "x_y_z"]


def test_latest_with_one_hot_key(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("docid"), F.col("id").alias("seq"), F.lit("U").alias("op"))
    got = mutate.live(df)
    assert got.count() == 1 + 20000 - 6667 and got.filter("docid = 'hot'").first().seq == 19998
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan  # combined before the shuffle


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    first = [{"id": i % 5, "text": f"v{i}", "age": i} for i in range(20)]
    second = [{"id": i % 3, "text": f"w{i}"} for i in range(7)]

    def put(name, items):
        (src / name).write_text("\n".join(json.dumps(x) if isinstance(x, dict) else x for x in items))

    c = Collection(spark, str(tmp_path / "c"), SPEC, buckets=4)
    told = []

    def run():
        q = ingest(
            json_lines_stream(spark, str(src), files_per_batch=1), c, str(tmp_path / "state"), available_now=True,
            on_batch=lambda df: told.append(df.first()),
        )
        q.awaitTermination()

    put("a.jsonl", [*first, "{broken"])
    run()
    assert (told[0].docs, told[0].unreadable, told[0].code) == (20, 1, 200)
    put("b.jsonl", second)
    run()  # restart: only the new file is read
    assert [r.batch for r in told] == [0, 1]
    batch = Collection(spark, str(tmp_path / "b"), SPEC, buckets=4)
    batch.append(rows(spark, first + second), 0)
    assert state(c) == state(batch)


def test_repeated_micro_batch_is_harmless(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "id int, text string, ver bigint")
    files, spec = str(tmp_path / "in"), IndexSpec.of("s", [Field("id", "i32", pk=True), Field("text")])
    df.write.parquet(files)
    c = Collection(spark, str(tmp_path / "c"), spec, buckets=2)
    for attempt in ("s1", "s2"):  # a lost stream state replays batch 0
        ingest(table_stream(spark, files, df.schema), c, str(tmp_path / attempt), seq="ver", available_now=True, name="s").awaitTermination()
    assert [(r.docid, r.text) for r in c.docs().select("docid", "doc.text").collect()] == [("1", "b")]
    assert c.summaries().count() == 1


def test_mixed_operations_row_by_row(spark, tmp_path):
    """One batch of upserts, updates and deletes in any order equals applying its rows one after the other."""
    rng = random.Random(5)
    stored = [{"id": i, "text": f"old {i}", "age": i} for i in range(0, 30, 2)]
    ops = [{"id": rng.randrange(12), "op": rng.choice("UPD")} for _ in range(60)] + [{"id": 40, "op": "P", "age": 1}, {"id": 41, "op": "D"}, {"id": 42, "op": "X"}, {"op": "U"}]
    for o in ops[:60]:
        o |= {k: v for k, v in (("text", f"t{rng.randrange(99)}"), ("age", rng.randrange(99)), ("extra", {"n": rng.randrange(9)})) if rng.random() < 0.5}
    want, lost = {str(d["id"]): (d["text"], d["age"], None) for d in stored}, []
    for seq, o in enumerate(ops):
        key, given = str(o.get("id")), [o.get("text"), o.get("age"), json.dumps(o["extra"]).replace(" ", "") if "extra" in o else None]
        if o["op"] == "D":
            want.pop(key, None)
        elif o["op"] == "P" and key not in want:
            lost.append(seq)
        elif o["op"] == "P":
            want[key] = tuple(new if new is not None else old for new, old in zip(given, want[key]))
        elif o["op"] == "U" and "id" in o:
            want[key] = tuple(given)
    c = Collection(spark, str(tmp_path / "mixed"), SPEC, buckets=4)
    c.append(rows(spark, stored))
    plain = rows(spark, [{k: v for k, v in o.items() if k != "op"} for o in ops])
    named = spark.createDataFrame([(i, o["op"]) for i, o in enumerate(ops)], "n long, op string")
    c.apply(plain.join(named, F.col("seq.pos") == F.col("n")).drop("n"))
    assert state(c) == want and lost
    log = spark.read.parquet(str(tmp_path / "mixed" / "log" / "rows" / "batch=1"))
    told = {r.seq.pos: r.error for r in log.filter("error IS NOT NULL").collect()}
    assert told == {**dict.fromkeys(lost, mutate.NOT_FOUND), 62: "unknown operation: X", 63: KEY_MISSING}
    assert found(spark, c, "old") and set(found(spark, c, "old")) == {k for k, v in want.items() if v[0] and v[0].startswith("old")}


def test_figures_after_batches_equal_a_recount(spark, tmp_path):
    """Replaced, deleted, written again, partly updated and mixed: the summed changes are what counting all documents gives."""
    from folioseek.operators.postings import corpus_stats, token_stats

    def check(c, some=True):
        t = c.tables()
        stats = {(r.scope, r.token): r.df for r in t.stats.collect()}
        assert stats == {(r.scope, r.token): r.df for r in token_stats(t.postings).collect()} and bool(stats) == some
        assert t.corpus.first() == corpus_stats(t.docs).first()
        read = t.stats._jdf.queryExecution().toString() + t.corpus._jdf.queryExecution().toString()
        assert "docid" not in read and "positions" not in read

    c = Collection(spark, str(tmp_path / "figures"), SPEC, buckets=2)
    c.append(rows(spark, [{"id": 1, "text": "a b a"}, {"id": 2, "text": "b c"}, {"id": 3, "text": ""}]))
    check(c)
    c.append(rows(spark, [{"id": 1, "text": "b d"}, {"id": 4, "text": "a"}, {"id": 4, "text": "e e f"}]))
    c.delete(spark.createDataFrame([(2,), (99,)], "id long"))
    c.update(rows(spark, [{"id": 3, "text": "g a"}, {"id": 1, "age": 7}, {"id": 50, "text": "none"}]))
    check(c)
    c.compact()
    c.append(rows(spark, [{"id": 2, "text": "c c b"}, {"id": 1, "text": "b d"}]))
    ops = [({"id": 2}, mutate.DELETE), ({"id": 2, "text": "h"}, mutate.UPSERT), ({"id": 3, "age": 1}, mutate.UPDATE), ({"id": 4}, mutate.DELETE)]
    names = spark.createDataFrame([(i, op) for i, (_, op) in enumerate(ops)], "i bigint, op string")
    mixed = rows(spark, [d for d, _ in ops])
    c.apply(mixed.join(names, F.col("seq.pos") == F.col("i")).drop("i"))
    check(c)
    assert {"h", "g"} <= {r.token for r in c.tables().stats.collect()}
    c.delete(spark.createDataFrame([(i,) for i in range(1, 5)], "id long"))
    check(c, False)


def test_postings_are_kept_once_and_not_shuffled(spark, tmp_path, monkeypatch):
    """A lone field's postings lie on disk under the document alone, in segments; larger layouts are shuffled, with the same rows."""
    from folioseek.operators.postings import postings
    from folioseek.plans import collection

    spec = IndexSpec.of("lone", [Field("id", "i64", pk=True), Field("text"), Field("n", "i64")])
    texts = ["a b a", "", "b c 'd e'", None, "a", " ".join(f"w{i % 50}" for i in range(400))]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id long, text string, n long")
    monkeypatch.setattr(collection, "LEAST_TOKENS", 100)
    found = []
    for most in (20_000, 0):
        monkeypatch.setattr(collection, "MANY_FILES", most)
        c = Collection(spark, str(tmp_path / f"c{most}"), spec, buckets=2)
        c.append(readers.from_table(rows), 0)
        c.compact()
        stored = spark.read.parquet(f"{c.path}/snap/gen=0/postings")
        assert {r.scope for r in stored.select("scope").distinct().collect()} == {""}
        t = c.tables()
        shown = {tuple(map(str, r)) for r in t.postings.drop("bucket").collect()}
        want = postings(t.docs.select("docid", "doc"), spec).select("scope", "token", "docid", "tf", "positions", "dl")
        assert shown == {tuple(map(str, r)) for r in want.collect()} and len(shown) == 2 * stored.count()
        assert {r.scope for r in t.stats.collect()} == {"", "text"}
        found.append(shown)
    assert found[0] == found[1]


def test_long_lists_of_tokens_cut_the_postings(spark, tmp_path, monkeypatch):
    """Many asked tokens are met by a broadcast, and a batch of must words alone deals out no postings."""
    from folioseek.plans import search

    spec = IndexSpec.of("cut", [Field("id", "i64", pk=True), Field("text")])
    texts = ["a b c", "b c d", "a c e", "f g"]
    c = Collection(spark, str(tmp_path / "c"), spec, buckets=1)
    c.build(readers.from_table(spark.createDataFrame(list(enumerate(texts)), "id long, text string")), unique=True)
    for occur, want in (("must", {(1, "0"), (1, "2")}), ("should", {(1, "0"), (1, "1"), (1, "2")})):
        monkeypatch.setattr(search, "LISTED_TOKENS", 1_000)
        listed = c.search(query_frame(spark, [(1, [(None, "a c", occur)])]))
        monkeypatch.setattr(search, "LISTED_TOKENS", 1)
        s = c.search(query_frame(spark, [(1, [(None, "a c", occur)])]))
        assert sorted(map(tuple, s.postings.select("scope", "token", "docid").collect())) == [("", t, str(i)) for t in "ac" for i, x in enumerate(texts) if t in x]
        assert {(r.qid, r.docid) for r in s.matches.collect()} == want and sorted(s.matches.collect()) == sorted(listed.matches.collect())
        plan = s._hits._jdf.queryExecution().optimizedPlan().toString()
        assert ("Repartition" in plan) == (occur == "should")


def _files(c, what):
    return c.spark.read.parquet(f"{c.path}/{what}").inputFiles() if c._exists(f"{c.path}/{what}") else []


def test_compaction_takes_over_batches_of_new_documents(spark, tmp_path, monkeypatch):
    """Documents that nothing replaced are not written a second time; a replaced or deleted one has all written anew."""
    monkeypatch.setattr("folioseek.plans.collection.LEAST_DOCS", 2)
    c = Collection(spark, str(tmp_path / "c"), SPEC, buckets=1)
    c.append(rows(spark, [{"id": 0, "text": "cat"}, {"id": 1, "text": "cat dog"}]))
    c.append(rows(spark, [{"id": 2, "text": "dog"}, {"id": 3, "text": "cat"}]))
    c.compact()
    assert not _files(c, "snap/gen=0/docs") and not _files(c, "snap/gen=0/postings")
    assert {k: v[0] for k, v in state(c).items()} == {"0": "cat", "1": "cat dog", "2": "dog", "3": "cat"}
    t = c.tables()
    assert {(r.token, r.df) for r in t.stats.filter("scope = ''").collect()} == {("cat", 3), ("dog", 2)} and t.postings.count() == 10
    c.append(rows(spark, [{"id": 0, "text": "dog"}, {"id": 4, "text": "dog"}]))
    c.compact()
    assert _files(c, "snap/gen=1/docs") and _files(c, "snap/gen=1/postings")
    assert {(r.token, r.df) for r in c.tables().stats.filter("scope = ''").collect()} == {("cat", 2), ("dog", 4)}


def test_many_batches_are_written_into_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("folioseek.plans.collection.MOST_PARTS", 2)
    monkeypatch.setattr("folioseek.plans.collection.LEAST_DOCS", 1)
    c = Collection(spark, str(tmp_path / "c"), SPEC, buckets=1)
    for i in range(4):
        c.append(rows(spark, [{"id": i, "text": "cat"}]))
        c.compact()
        assert bool(_files(c, f"snap/gen={i}/docs")) == (i == 2)
    assert sorted(state(c)) == ["0", "1", "2", "3"]


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_latest_of_few(spark, small):
    """Single versions stay where they are, repeated ones give their last; with many repeated keys it is the plain way."""
    seen = [("a", 1, "x"), ("b", 1, "y"), ("a", 3, "z"), ("c", 2, None), ("a", 2, "w")]
    got = mutate.latest_of_few(spark.createDataFrame(seen, "docid string, seq int, doc string"), small)
    assert sorted(map(tuple, got.select("docid", "seq", "doc").collect())) == [("a", 3, "z"), ("b", 1, "y"), ("c", 2, None)]
    once = mutate.latest_of_few(spark.createDataFrame(seen[:2], "docid string, seq int, doc string"), small)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.docid for r in once.collect()) == ["a", "b"] and "Exchange" not in plan


def test_new_documents_are_read_where_they_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("folioseek.plans.collection.SMALL_BYTES", 0)
    c = Collection(spark, str(tmp_path / "new"), SPEC, buckets=4)
    plan = lambda: c.docs()._jdf.queryExecution().executedPlan().toString()
    c.append(rows(spark, [{"id": i, "text": f"word {i}"} for i in range(5)]))
    c.append(rows(spark, [{"id": i, "text": f"word {i}"} for i in range(5, 9)]))
    assert "Exchange" not in plan()
    c.compact()
    c.append(rows(spark, [{"id": 9, "text": "word 9"}]))
    assert "Exchange" not in plan()
    want = {str(i): (f"word {i}", None, None) for i in range(10)}
    assert state(c) == want

    # Ids that are stored already, one of them twice, and a deleted one.
    c.append(rows(spark, [{"id": 3, "text": "old"}, {"id": 3, "text": "other"}, {"id": 9, "text": "other"}, {"id": 10, "text": "other"}]))
    want |= {i: ("other", None, None) for i in ("3", "9", "10")}
    assert state(c) == want
    c.delete(spark.createDataFrame([("4",), ("77",)], "id string"))
    del want["4"]
    assert state(c) == want and set(found(spark, c, "word")) == {"0", "1", "2", "5", "6", "7", "8"}
    c.compact()
    assert state(c) == want and found(spark, c, "word other") == found(spark, fresh(spark, tmp_path, "same", *[{"id": int(i), "text": v[0]} for i, v in want.items()]), "word other")


def test_one_file_of_a_stream_is_shared_out(spark, tmp_path):
    files = str(tmp_path / "files")
    spark.range(4000).selectExpr("id", "concat('word ', id) AS text").coalesce(1).write.parquet(files)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    try:
        c = Collection(spark, str(tmp_path / "dealt"), SPEC, buckets=2)
        stream = table_stream(spark, files, spark.read.parquet(files).schema)
        ingest(stream, c, str(tmp_path / "state"), seq="id", available_now=True).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    sizes = [r["count"] for r in spark.read.parquet(c._at("log", "rows")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and sum(sizes) == 4000 and max(sizes) < 4000
    assert c.docs().count() == 4000


def test_last_versions_are_picked_among_the_documents_a_batch_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("folioseek.plans.collection.SMALL_BYTES", 60)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        c = Collection(spark, str(tmp_path / "named"), SPEC, buckets=2)
        c.append(rows(spark, [{"id": i, "text": f"word {i}"} for i in range(5)]))
        c.append(rows(spark, [{"id": 3, "text": "other"}]))  # from here on not all rows of the log are live
        c.delete(spark.createDataFrame([("4",)], "id string"))
        ids = spark.createDataFrame([(str(i),) for i in (3, 4, *range(10, 30))], "docid string")
        stored = c._stored(ids, 3)
        assert "SortMergeJoin" not in stored._jdf.queryExecution().executedPlan().toString()
        assert [(r.docid, r.doc.text) for r in stored.collect()] == [("3", "other")]
        c.compact()
        c.append(rows(spark, [{"id": 2, "text": "newer"}, {"id": 3, "text": "newer"}]))
        c.delete(spark.createDataFrame([("3",)], "id string"))
        ids = ids.unionByName(spark.createDataFrame([("1",), ("2",)], "docid string"))
        want = [("1", "word 1"), ("2", "newer")]
        for small in (60, 0, 1 << 20):  # named documents are few, many, and the batch itself is small
            monkeypatch.setattr("folioseek.plans.collection.SMALL_BYTES", small)
            assert sorted((r.docid, r.doc.text) for r in c._stored(ids, 5).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
