"""Files cut by ranges of bytes: the same documents wherever the cuts fall."""

import csv
import io
import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from folioseek import Field, IndexSpec
from folioseek.operators.typed import typed_read
from folioseek.sources import ranges, readers

SPEC = IndexSpec.of("t", [Field("id", "i64", pk=True), Field("name")])
NASTY = ["plain", "", 'a "quoted" b', "}{][", '"', '\\"}', "back\\", "\\\\", "line\nbreak", "},\n{", "词}元", "tab\t,]", '""', "x" * 300, "'", "null,"]


@contextmanager
def split_bytes(spark, n):
    names = {"spark.sql.files.maxPartitionBytes": str(n), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "64"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _json(rows):
    return rows.select("seq", F.to_json("payload").alias("js"), "error").orderBy("seq").collect()


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_json_arrays_cut_anywhere(spark, tmp_path, size):
    rng, files = random.Random(size), {}
    for i in range(3):
        docs = [None if rng.random() < 0.1 else {"id": j, "name": rng.choice(NASTY), "in": {"a": [{"b": rng.choice(NASTY)}, []], "e": {}}} for j in range(40)]
        text = json.dumps(docs, indent=rng.choice([None, 1]), ensure_ascii=False)
        (tmp_path / f"{i}.json").write_text(text + rng.choice(["", "\n", " \n"]))
        files[f"{i}.json"] = docs
    with split_bytes(spark, size):
        if size < 1 << 20:
            assert ranges.pieces(spark, str(tmp_path), "}").select("file", "block").distinct().count() > 30
        got = _json(readers.read_json_array(spark, str(tmp_path)))
    for name, docs in files.items():
        assert [json.loads(r.js) if r.js else None for r in got if r.seq.source.endswith(name)] == docs
    assert all(r.error is None for r in got)


BAD = {
    "closed late": '[{"id": 1}]}', "closed never": '[{"id": 1}', "comma": '[{"id": 1},]', "no comma": '[{"id": 1} {"id": 2}]', "two": '[{"id": 1}] [{"id": 2}]',
    "number": '[{"id": 1}, 7]', "first a number": '[7, {"id": 1}]', "nested": '[[{"id": 1}]]', "object": '{"id": 1}', "after": '[{"id": 1}] x', "blank": " \n",
    "null then array": '[null] [{"id": 1}]', "open text": '[{"id": "1}]', "single": "[{'id': 1}]", "brackets": '[{"id": [1}]]', "empty first": '[] {"id": 1}]', "double": '[{"id": 1},,{"id": 2}]',
}
GOOD = {"no bytes": "", "none": "[]", "spaces": " [ \n] \n", "nulls": "[null, null]", "null last": '[{"id": 1}, null ]\n', "mark": '﻿[{"id": 1}]'}


def test_bad_arrays_are_one_error_each(spark, tmp_path):
    for i, text in enumerate([*BAD.values(), *GOOD.values()]):
        (tmp_path / f"f{i:02}.json").write_text(text, encoding="utf-8")
    names = [*BAD, *GOOD]
    for size in (3, 1 << 20):
        with split_bytes(spark, size):
            got = _json(readers.read_json_array(spark, str(tmp_path), on_bad_file="report"))
        per = {n: [] for n in names}
        for r in got:
            per[names[int(r.seq.source.split("/f")[-1][:2])]].append((r.js, r.error is not None))
        assert {n: v for n, v in per.items() if n in BAD and v != [(None, True)]} == {}
        assert {n: len(per[n]) for n in GOOD} == {"no bytes": 0, "none": 0, "spaces": 0, "nulls": 2, "null last": 2, "mark": 1}
        assert not any(told for n in GOOD for _, told in per[n])
    for name in ("closed late", "blank", "number", "comma"):
        with pytest.raises(Exception, match="not a JSON array of objects"):
            readers.read_json_array(spark, str(tmp_path / f"f{names.index(name):02}.json")).collect()


@pytest.mark.parametrize("size", [9, 100, 1 << 20])
def test_csv_cut_anywhere(spark, tmp_path, size):
    """Line breaks in quotes, other header orders and columns, both line ends."""
    rng, want = random.Random(size), []
    for i, head in enumerate((["id", "name", "more"], ["name", "id", "more"], ["id", "more", "name", "extra"], ["more", "name", "id"])):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        writer.writerow(head)
        for j in range(30):
            row = {"id": str(100 * i + j), "name": rng.choice(NASTY), "more": rng.choice(["", "a,b", "two\nlines\n\nmore", '"q"\n']), "extra": "e"}
            writer.writerow([row[c] for c in head])
            want.append((row["id"], row["name"], row["more"], "e" if i == 2 else None))
        (tmp_path / f"{i}.csv").write_bytes(out.getvalue().encode())
    with split_bytes(spark, size):
        got = readers.read_csv(spark, str(tmp_path)).orderBy("seq").select("payload.id", "payload.name", "payload.more", "payload.extra", "error").collect()
    assert [r.error for r in got if r.error] == []
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)
    assert [int(r.id) % 100 for r in got if int(r.id) < 100] == list(range(30))


def test_csv_quotes_that_open_nothing(spark, tmp_path):
    """A quote inside a bare cell is a character; a row of other length is an error and reading goes on."""
    p = tmp_path / "a.csv"
    p.write_text('id,name\n1,5" pipe\n2,b"c,\n3,"x ""y"", z\n"\n\n4,"in" out\n5,""\n6\n7,last')
    for size in (4, 1 << 20):
        with split_bytes(spark, size):
            got = readers.read_csv(spark, str(p)).orderBy("seq").collect()
        assert [r.payload and r.payload.id for r in got] == ["1", None, "3", "4", "5", None, "7"]
        assert got[0].payload.name == '5" pipe' and got[2].payload.name == 'x "y", z\n' and got[4].payload.name == "" and got[6].payload.name == "last"
        assert got[1].error == 'wrong number of cells: 2,b"c,' and got[5].error == "wrong number of cells: 6"


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "head.csv").write_text("id,name\n")
    assert typed_read(readers.read_csv(spark, str(tmp_path)), SPEC).count() == 0


def test_csv_texts_are_looked_at_once(spark, tmp_path, monkeypatch):
    """Lines are cut and matched in one scan, written down, and shuffled once; a record is parsed once."""
    for i, head in enumerate(("id,name\n", '\n \n"id\n",name,x\n')):
        (tmp_path / f"{i}.csv").write_text(head + "".join(f'{j},"a ""b""\n{j}"{",y" * i}\n' for j in range(20)))
    real, scans = ranges.pieces, []
    monkeypatch.setattr(ranges, "pieces", lambda *a: scans.append(1) or real(*a))
    rows = readers.read_csv(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    got = rows.orderBy("seq").collect()
    assert len(got) == 40 and not [r.error for r in got if r.error]
    assert [r.payload["id\n"] for r in got if r.payload.x] == [str(j) for j in range(20)]
    assert "lineSep" not in plan and "regexp_replace(value" not in plan and plan.count("from_csv(") <= 2 and len(scans) == 1
