import random

from pyspark.sql import functions as F

from folioseek.functions import text

SAME = None
# (text, space tokens, zh tokens or SAME)
GOLDEN = [
    ("this is a test", ["this", "is", "a", "test"], SAME),
    ("这是,一个 测试 .i.b.m.", ["这是", "一个", "测试", "i.b.m"], ["这", "是", "一", "个", "测", "试", "i.b.m"]),
    (
        '这离有"引号 引号里面空格保留",还有不配对引号"  哈哈 还有空格  ',
        ["这离有", "引号 引号里面空格保留", "还有不配对引号", "哈哈", "还有空格"],
        list("这离有") + ["引号 引号里面空格保留"] + list("还有不配对引号哈哈还有空格"),
    ),
    (
        "单双引号\"引号 引号里面空格保留\",还有不配对引号\"  哈哈 还有'但引号 带空格'空格  ",
        ["单双引号", "引号 引号里面空格保留", "还有不配对引号", "哈哈", "还有", "但引号 带空格", "空格"],
        list("单双引号") + ["引号 引号里面空格保留"] + list("还有不配对引号哈哈还有") + ["但引号 带空格"] + list("空格"),
    ),
    ("更多的测试,2019-10-14 17:02:01", ["更多的测试", "2019-10-14", "17:02:01"], list("更多的测试") + ["2019-10-14", "17:02:01"]),
    ("hello, 世界！", ["hello", "世界"], ["hello", "世", "界"]),
    ("日文的之（の）和的（の）有区别吗？", ["日文的之", "の", "和的", "の", "有区别吗"], list("日文的之の和的の有区别吗")),
    ('f:"实在"', ["f", "实在"], SAME),
    ('f:+"实在"', ["f:+", "实在"], SAME),
    ('f:+"实在" -"有意思"', ["f:+", "实在", "有意思"], SAME),
    ('f:+"实在" -有意思', ["f:+", "实在", "有意思"], ["f:+", "实在", "有", "意", "思"]),
    ("it's Bob's dog", ["it", "s Bob", "s", "dog"], SAME),
    ("don't stop", ["don", "t", "stop"], SAME),
    ("a_b c+d=e $5 http://x.y/z?k=v --a-- ...", ["a", "b", "c+d=e", "$5", "http", "x.y", "z", "k=v", "a"], SAME),
    ("", [], SAME),
    ("''  \"\" `q` x　y", ["q", "x", "y"], SAME),
    ("'.a.' \"b.\n\" \"'c'\"", ["a", "b.\n", "'c'"], SAME),
    ("Case stays Case", ["Case", "stays", "Case"], SAME),
]


def test_golden_tokens(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, s string")
    rows = df.select("i", text.tokens(F.col("s")).alias("sp"), text.tokens(F.col("s"), text.HAN).alias("zh")).collect()
    for r in rows:
        s, space, zh = GOLDEN[r.i]
        assert r.sp == space, s
        assert r.zh == (space if zh is SAME else zh), s


def test_null_and_none_give_no_tokens(spark):
    df = spark.createDataFrame([(None,), ("a b",)], "s string")
    rows = df.select(text.tokens(F.col("s")).alias("a"), text.tokens(F.col("s"), text.NONE).alias("b")).collect()
    assert [r.a for r in rows] == [[], ["a", "b"]]
    assert all(r.b == [] for r in rows)


def test_token_properties(spark):
    rng = random.Random(7)
    alphabet = list("abcXY.-:,;!'\"` \t\n(){}世界の_+$é") + ["\u0085", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for mode in (text.SPACE, text.HAN):
        for r in df.select("s", text.tokens(F.col("s"), mode).alias("t"), text.token_count(F.col("s"), mode).alias("n")).collect():
            assert r.n == len(r.t)
            assert all(t and t in r.s for t in r.t)
            assert all(t[0] not in ".-:" and t[-1] not in ".-:" for t in r.t)
            # tokens come in text order and do not overlap
            at = 0
            for t in r.t:
                at = r.s.index(t, at) + len(t)


def test_long_runs_do_not_overflow(spark):
    s = "a.b-" * 100_000 + "z"
    n = spark.createDataFrame([(s,)], "s string").select(F.size(text.tokens(F.col("s"))).alias("n")).first().n
    assert n == 1


def test_has_token_is_whole_token(spark):
    df = spark.createDataFrame([("red ring",), ("reddish",), (None,)], "s string")
    rows = df.select(text.has_token(F.col("s"), F.lit("red")).alias("h")).collect()
    assert [bool(r.h) for r in rows] == [True, False, False]
