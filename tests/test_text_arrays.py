import random

import pytest
from pyspark.sql import functions as F

from folioseek import Field, IndexSpec
from folioseek.functions import text, text_arrays
from folioseek.operators.postings import bulk_postings, doc_lengths, postings

ODD = [
    None, "", " ", "a", "世", "a世b界", "-a.b:c- .d. e--f", "x:.y 测.试 z.", "'a b' c", "it's 'x.-' '' \"--\" `q` '", "\"a 'b\" c' d'",
    "'.- 世界 x -.' y", "a\nb c　d e", "é·ß—«x» 𠀀a𠀀", "𝒳-𝒳 ♥ ＡＢ", "\u0000a\u0000 b", "'𠀀' \"", "...", "'a''b'", "a'b'c", "々〇〆 ㍿",
]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("ab.:- '\"`世中\n😀é") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    return ODD + made + ["世 a.b " * 3000, "".join(chr(i) for i in range(1, 0x3000)), None, "last"]


def spec(tokenizer):
    return IndexSpec.of("t", [Field("id", "i64", pk=True), Field("text", tokenizer=tokenizer)])


@pytest.mark.parametrize("tokenizer", [text.HAN, text.SPACE])
def test_same_postings_as_the_expressions(spark, monkeypatch, tokenizer):
    monkeypatch.setattr(text_arrays, "PIECE", 500)
    rows = spark.createDataFrame(list(enumerate(texts())), "id long, text string").repartition(3)
    docs = rows.select(F.col("id").cast("string").alias("docid"), F.struct("id", "text").alias("doc"))
    want = postings(docs, spec(tokenizer), "global")
    got = bulk_postings(docs, spec(tokenizer))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    lengths = [sorted(map(tuple, doc_lengths(docs, spec(tokenizer), many).collect())) for many in (False, True)]
    assert lengths[0] == lengths[1] and len(lengths[0]) == len(texts())


def test_class_of_every_code_point(spark):
    """Each code point alone, between letters and between Han characters."""
    points = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    lines = ["".join(f"a{c}b世{c}界 " for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    docs = spark.createDataFrame(list(enumerate(lines)), "id long, text string").filter("text not rlike '[\\'\"`]'")
    docs = docs.select(F.col("id").cast("string").alias("docid"), F.struct("id", "text").alias("doc"))
    for tokenizer in (text.HAN, text.SPACE):
        total = lambda rows: rows.agg(F.count(F.lit(1)), F.sum("tf"), F.sum(F.xxhash64("docid", "token", "positions", "dl").cast("decimal(38,0)"))).first()
        assert total(bulk_postings(docs, spec(tokenizer))) == total(postings(docs, spec(tokenizer), "global"))
