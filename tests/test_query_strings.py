import pytest
from pyspark.sql import functions as F

from folioseek.functions import query_strings as qs
from folioseek.operators.filters import Filter
from folioseek.operators.sorting import Sort


def asked(spark, q, fq=None):
    df = spark.createDataFrame([(q, fq)], "q string, fq string")
    return [tuple(c) for c in df.select(qs.clauses(F.col("q"), F.col("fq")).alias("c")).first().c]


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("+spark", [("spark", "must")]),
        ('a  +b\t-c　"two words"', [("a", "should"), ("b", "must"), ("c", "must_not"), ('"two words"', "should")]),
        ("+'x y' -`p q`z", [("'x y'", "must"), ("`p q`z", "must_not")]),
        ('say"it now', [('say"it now', "should")]),
        ("+ - ++a --b +-c", [("+a", "must"), ("-b", "must_not"), ("-c", "must")]),
        ("世界", [("世界", "should")]),
        ("  ", []),
        ("", []),
        (None, []),
    ],
)
def test_q(spark, q, want):
    assert asked(spark, q) == [(None, t, o) for t, o in want]


def test_fq(spark):
    assert asked(spark, "x", 'tags:世界 +b,name:"a, b";bare;:no;age:;n:a:b') == [
        (None, "x", "should"), ("tags", "世界", "should"), ("tags", "b", "must"), ("name", '"a, b"', "should"), ("n", "a:b", "should"),
    ]
    assert asked(spark, None, None) == [] and asked(spark, None, "f:-w") == [("f", "w", "must_not")]


def test_strict_in_field_queries(spark):
    strict = lambda fq: spark.createDataFrame([("x", fq)], "q string, fq string").select(qs.clauses(F.col("q"), F.col("fq"), strict=True).alias("c")).first().c
    assert [tuple(c) for c in strict("tags:a -b;bare;:no")] == [(None, "x", "should"), ("tags", "a", "should"), ("tags", "b", "must_not")]
    assert len(strict(None)) == 1
    for fq in ("age:", "tags:a;age: ", "age:+ -"):
        with pytest.raises(Exception, match="no words in the field query age"):
            strict(fq)


def test_arguments_in_place():
    assert qs.filters('age:10,12~15,20~;tags:"学生;x,y";bad;:1;none:;a:~,') == [
        Filter("age", ["10"], [("12", "15"), ("20", "")]), Filter("tags", ['"学生;x,y"'], []), Filter("a", [], [("", "")]),
    ]
    assert qs.sorts("age:asc,update-time;x:desc y asc,, z:") == [Sort("age", "asc"), Sort("update-time"), Sort("x"), Sort("z")]
    assert qs.fields("id, age,,name ") == ["id", "age", "name"]
    assert qs.filters("") == [] and qs.filters(None) == [] and qs.sorts("") == [] and qs.fields("") is None and qs.fields(None) is None
