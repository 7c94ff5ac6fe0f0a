import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioseek import Field, IndexSpec
from folioseek.functions.coerce import render
from folioseek.operators import mutate, report
from folioseek.operators.project import json_document, output_columns
from folioseek.operators.typed import KEY_MISSING, NOT_AN_OBJECT, accepted, rejected, typed_read
from folioseek.sources import readers
from folioseek.spec import layout_pattern

MISSING = object()


def coerced(spark, kind, values, **field):
    """Values of one field through JSON: the converted value or 'ERR'."""
    spec = IndexSpec.of("t", [Field("k", "i64", pk=True), Field("x", kind, **field)])
    lines = [json.dumps({"k": i} | ({} if v is MISSING else {"x": v})) for i, v in enumerate(values)]
    df = spark.createDataFrame(list(enumerate(lines)), "i bigint, value string")
    docs = df.select(
        F.struct(F.col("i").alias("pos")).alias("seq"), F.parse_json("value").alias("payload"), F.lit(None).cast("string").alias("error")
    )
    shown = render(F.col("doc")["x"], spec.get("x"), spec.zone)
    if kind == "json":
        shown = F.to_json(shown)
    rows = typed_read(docs, spec).select("seq.pos", shown.alias("x"), "error").orderBy("pos").collect()
    return ["ERR" if r.error else r.x for r in rows]


EDGES = [None, MISSING, "", "12", " 12 ", "1.0", 1.9, 300, "yes", "Y", "maybe", "2", True, -1, {"a": 1}, "12\n", "+5"]


@pytest.mark.parametrize(
    "kind,want",
    [
        ("i8", [0, None, 0, 12, "ERR", "ERR", 1, "ERR", "ERR", "ERR", "ERR", 2, "ERR", -1, "ERR", "ERR", 5]),
        ("i64", [0, None, 0, 12, "ERR", "ERR", 1, 300, "ERR", "ERR", "ERR", 2, "ERR", -1, "ERR", "ERR", 5]),
        ("u16", [0, None, 0, 12, "ERR", "ERR", 1, 300, "ERR", "ERR", "ERR", 2, "ERR", "ERR", "ERR", "ERR", "ERR"]),
        ("f64", [0.0, None, 0.0, 12.0, "ERR", 1.0, 1.9, 300.0, "ERR", "ERR", "ERR", 2.0, "ERR", -1.0, "ERR", "ERR", 5.0]),
        ("bool", [False, None, False, True, False, False, True, True, True, True, False, True, True, True, "ERR", False, True]),
        (
            "str",
            ["", None, "", "12", " 12 ", "1.0", "1.9", "300", "yes", "Y", "maybe", "2", "true", "-1", '{"a":1}', "12\n", "+5"],
        ),
    ],
)
def test_coercion_edges(spark, kind, want):
    assert coerced(spark, kind, EDGES) == want


def test_wide_unsigned_and_limits(spark):
    top = 2**64 - 1
    assert coerced(spark, "u64", [str(top), str(top + 1), top, 0.5, -0.5]) == [Decimal(top), "ERR", Decimal(top), 0, 0]
    assert coerced(spark, "i64", [str(2**63 - 1), str(2**63)]) == [2**63 - 1, "ERR"]
    assert coerced(spark, "u8", [255, 256, "255"]) == [255, "ERR", 255]


def test_floats(spark):
    got = coerced(spark, "f64", ["1e3", "-.5", "5.", "1d", "inf", "1e999", "0x1"])
    assert got == [1000.0, -0.5, 5.0, "ERR", float("inf"), "ERR", "ERR"]


def test_times(spark):
    assert coerced(spark, "datetime", ["2019-10-10 19:01:48", "bad", "", None, 1_500_000_000, MISSING]) == [
        "2019-10-10 19:01:48", "ERR", "ERR", "1970-01-01 08:00:00", "1970-01-01 08:00:01", None,
    ]
    assert coerced(spark, "date", ["2019-10-17", "2019-13-01"]) == ["2019-10-17", "ERR"]
    assert coerced(spark, "time", ["09:01:58", "25:00:00"]) == ["09:01:58", "ERR"]
    assert coerced(spark, "datetime", ["10/17/19 5"], time_fmt="MM/dd/yy H") == ["10/17/19 5"]


def test_times_do_not_depend_on_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert coerced(spark, "datetime", ["2019-07-10 19:01:48", 0]) == ["2019-07-10 19:01:48", "1970-01-01 08:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_json_null_is_not_absent(spark):
    assert coerced(spark, "json", [None, MISSING, {"a": [1, None]}, "s", 2]) == ["null", None, '{"a":[1,null]}', '"s"', "2"]


def test_rejections_keys_and_ids(spark):
    spec = IndexSpec.of(
        "t", [Field("a", pk=True, tokenizer="none"), Field("n", "i32"), Field("m", "i32"), Field("b", "datetime", pk=True)]
    )
    lines = [
        '{"a": " x ", "b": 5000, "n": "1", "zzz": 1}',
        '{"a": "y"}',
        '{"m": "bad m", "n": "bad n"}',
        "[1]",
        '{"a": null, "b": null}',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "i bigint, value string").select(
        F.struct(F.col("i").alias("pos")).alias("seq"), F.parse_json("value").alias("payload"), F.lit(None).cast("string").alias("error")
    )
    rows = typed_read(df, spec).orderBy("seq").collect()
    assert rows[0].docid == " x _5000" and rows[0].doc.a == "x" and rows[0].doc.n == 1
    assert rows[1].error == KEY_MISSING and rows[1].doc is None
    assert "bad n" in rows[2].error  # first failure in field order
    assert rows[3].error == NOT_AN_OBJECT
    assert rows[4].docid == "_0"
    s = report.batch_summary(typed_read(df, spec), "t").first()
    assert (s.docs, s.failed, s.unreadable, s.code) == (2, 3, 0, 500)


def test_spec_checks():
    with pytest.raises(ValueError, match="no fields"):
        IndexSpec.of("t", [])
    with pytest.raises(ValueError, match="no name"):
        IndexSpec.of("t", [Field("")])
    with pytest.raises(ValueError, match="twice"):
        IndexSpec.of("t", [Field("a", pk=True), Field("a")])
    with pytest.raises(ValueError, match="unknown type"):
        IndexSpec.of("t", [Field("a", "i128", pk=True)])
    with pytest.raises(ValueError, match="unknown tokenizer"):
        IndexSpec.of("t", [Field("a", tokenizer="en", pk=True)])
    with pytest.raises(ValueError, match="primary-key"):
        IndexSpec.of("t", [Field("a")])
    spec = IndexSpec.from_dict(
        "t", {"fields": [{"name": "id", "pk": True}, {"name": "d", "type": "date", "sorting": "asc"}, {"name": "e", "sorting": "up"}]}
    )
    assert [f.type for f in spec.fields] == ["str", "date", "str"]
    assert spec.get("d").time_fmt == "yyyy-MM-dd" and spec.get("id").tokenizer == "space"
    assert spec.default_sort == (("d", "asc"),)
    assert spec.struct_type()["d"].metadata["sorting"] == "asc"


@pytest.fixture
def people():
    return IndexSpec.of("p", [Field("id", "u32", pk=True), Field("name", tokenizer="zh"), Field("age", "u16"), Field("tags")])


def test_json_lines_keep_going_and_keep_order(spark, people, tmp_path):
    lines = [json.dumps({"id": i % 50, "age": i}) for i in range(5000)]
    lines[7] = "{broken"
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:4000]) + "\n\n")
    (tmp_path / "b.jsonl").write_text("\n".join(lines[4000:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opening = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        # Many small splits: order has to survive them.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        docs = readers.read(spark, str(tmp_path / "a.jsonl"))
        typed = typed_read(docs, people)
        assert docs.rdd.getNumPartitions() > 10
        rows = typed.orderBy("seq").select("docid", "doc.age", "error").collect()
        assert len(rows) == 4000 and [r.age for r in rows] == [None if i == 7 else i for i in range(4000)]
        assert rows[7].error.startswith("not JSON") and rejected(typed).count() == 1
        last = mutate.latest(accepted(typed).select("docid", "seq", "doc")).select("docid", "doc.age").collect()
        assert {r.docid: r.age for r in last} == {str(i): 3950 + i for i in range(50)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opening)
    assert typed_read(readers.read(spark, str(tmp_path), "jsonl"), people).count() == 5000


def test_json_array_is_all_or_nothing(spark, people, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"id": 1, "name": "x"}, None, {"id": 2}]))
    bad.write_text(json.dumps([{"id": 3}, 7]))
    rows = typed_read(readers.read(spark, str(good)), people).orderBy("seq").collect()
    assert [r.docid for r in rows] == ["1", None, "2"] and rows[1].error == KEY_MISSING
    with pytest.raises(Exception, match="not a JSON array of objects"):
        readers.read(spark, str(bad)).collect()
    told = typed_read(readers.read(spark, str(bad), on_bad_file="report"), people).collect()
    assert len(told) == 1 and told[0].stage == "read"


def test_large_json_array(spark, people, tmp_path):
    """A file above the limit of one VARIANT (128 MiB) is read like any other."""
    p, filler = tmp_path / "large.json", "x" * 1_000_000
    with p.open("w") as out:
        out.write("[" + ",".join(json.dumps({"id": i, "name": filler}) for i in range(140)) + "]\n")
    assert p.stat().st_size > 128 << 20
    got = typed_read(readers.read(spark, str(p)), people).select("docid", F.length("doc.name").alias("n"), "error").collect()
    assert len(got) == 140 and all(r.error is None and r.n == 1_000_000 for r in got)


def test_rejected_values_are_kept_whole(spark, people, tmp_path):
    long = "y" * 1_000
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": 1, "age": long}) + "\n{" + long)
    errors = {r.error for r in typed_read(readers.read(spark, str(tmp_path / "a.jsonl")), people).collect()}
    assert errors == {f"field age: can not convert {long} to u16", "not JSON: {" + long}


def test_time_layouts(spark):
    for layout, pattern in {
        "2006-01-02": "yyyy-MM-dd", "02/Jan/06 03:04:05.000 PM": "dd/MMM/yy hh:mm:ss.SSS a", "2006-01-02T15:04:05": "yyyy-MM-dd'T'HH:mm:ss",
        "yyyy/MM/dd": "yyyy/MM/dd", "15h04": "HH'h'mm", "1/2/2006": "M/d/yyyy",
    }.items():
        assert layout_pattern(layout) == pattern
    with pytest.raises(ValueError, match="reference moment"):
        layout_pattern("2019-10-14")
    spec = IndexSpec.from_dict("t", {"fields": [{"name": "id", "type": "i32", "pk": True}, {"name": "d", "type": "date", "time-fmt": "02.01.2006"}]})
    raw = spark.createDataFrame([(1, "14.10.2019"), (2, "2019-10-14")], "id int, d string")
    got = typed_read(readers.from_table(raw), spec).orderBy("seq").collect()
    assert got[0].error is None and "can not convert" in got[1].error


def test_csv(spark, people, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,name,age,tags\n1,"a ""q"" b",10,x y\n2,short\n3,,,"multi\nline"\n4,a,b,c,d\n5,a,old,c\n')
    rows = typed_read(readers.read(spark, str(p)), people).orderBy("seq").collect()
    assert [r.docid for r in rows] == ["1", None, "3", None, None]
    assert rows[0].doc.name == 'a "q" b' and rows[2].doc.age == 0 and rows[2].doc.tags == "multi\nline"
    assert [r.stage for r in rows] == [None, "read", None, "read", "convert"]
    s = report.batch_summary(typed_read(readers.read(spark, str(p)), people), "p").first()
    assert (s.docs, s.unreadable, s.failed, s.code) == (2, 2, 1, 500)


def test_format_choice():
    assert readers.format_of("x/a.csv") == "csv" and readers.format_of("a.JSONL") == "jsonl"
    assert readers.format_of("a.txt") == "json" and readers.format_of("a.csv", "application/x-ndjson") == "jsonl"
    assert readers.format_of("a", "text/csv; charset=utf-8") == "csv" and readers.format_of("a", "x/y") == "json"


def test_table_source_types(spark):
    spec = IndexSpec.of(
        "t",
        [Field("k", "str", pk=True), Field("at", "datetime"), Field("day", "date"), Field("clock", "time"), Field("flag", "bool"), Field("raw", "json")],
        zone="Asia/Shanghai",
    )
    ts = dt.datetime(2020, 2, 3, 4, 5, 6)
    df = spark.createDataFrame([(1.0, ts, ts, ts, 2, [1, 2]), (2.5, None, None, None, None, None)], "k double, at timestamp_ntz, day timestamp_ntz, clock timestamp_ntz, flag int, raw array<int>")
    rows = accepted(typed_read(readers.from_table(df), spec)).select("docid", *output_columns(None, spec), json_document(None, spec).alias("js")).orderBy("docid").collect()
    assert rows[0].docid == "1" and rows[1].docid == "2.5"
    assert (rows[0].at, rows[0].day, rows[0].clock) == ("2020-02-03 04:05:06", "2020-02-03", "04:05:06")
    assert rows[0].flag is True
    assert json.loads(rows[0].js)["raw"] == [1, 2] and json.loads(rows[1].js) == {"k": "2.5"}


def test_unknown_output_field_fails(people):
    with pytest.raises(ValueError, match="no field nope"):
        output_columns(["id", "nope"], people)
