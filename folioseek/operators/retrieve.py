"""Boolean retrieval and ranking for a whole table of queries.

``queries`` has ``qid`` and ``clauses ARRAY<STRUCT<field, text, occur>>``; ``field`` NULL
means the whole document, ``occur`` is ``should``, ``must`` or ``must_not``.  Whole-document
and in-field clauses feed the same three lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..spec import IndexSpec
from .postings import GLOBAL

SHOULD, MUST, MUST_NOT = "should", "must", "must_not"
ROLES = ["is_should", "is_must", "is_not"]
CLAUSES = "array<struct<field:string,text:string,occur:string>>"

# Tokens held by more documents than this are split over several tasks in shuffle joins.
HOT_DF = 1_000_000


def clause(text_: Column, occur: str, field: str | None = None) -> Column:
    return F.struct(
        F.lit(field).cast("string").alias("field"), text_.alias("text"), F.lit(occur).alias("occur")
    )


def _clause_tokens(c: Column, spec: IndexSpec) -> Column:
    """Whole-document clauses always use the Han analyser, in-field ones the field's.

    Unknown fields and fields analysed by ``none`` give no tokens.
    """
    by_space = [f.name for f in spec.fields if f.tokenizer == text.SPACE]
    by_han = [f.name for f in spec.fields if f.tokenizer == text.HAN]
    return (
        F.when(c["field"].isNull() | c["field"].isin(by_han), text.tokens(c["text"], text.HAN))
        .when(c["field"].isin(by_space), text.tokens(c["text"], text.SPACE))
        .otherwise(text.no_tokens())
    )


def clause_tokens(queries: DataFrame, spec: IndexSpec) -> DataFrame:
    """``(qid, cno, tno, scope, token, occur)``: every token in clause order."""
    rows = queries.select("qid", F.posexplode("clauses").alias("cno", "c"))
    return rows.select(
        "qid",
        "cno",
        F.coalesce("c.field", F.lit(GLOBAL)).alias("scope"),
        F.col("c.occur").alias("occur"),
        F.posexplode(_clause_tokens(F.col("c"), spec)).alias("tno", "token"),
    )


def query_tokens(queries: DataFrame, spec: IndexSpec) -> DataFrame:
    """Distinct tokens of each query with their roles and the query's list sizes.

    The work is done inside the query's row: clause tokens are flattened, made distinct
    and exploded, so no shuffle is needed.
    """
    listed = F.flatten(
        F.transform(
            F.coalesce("clauses", F.array().cast(CLAUSES)),
            lambda c: F.transform(
                _clause_tokens(c, spec),
                lambda t: F.struct(
                    F.coalesce(c["field"], F.lit(GLOBAL)).alias("scope"),
                    t.alias("token"),
                    c["occur"].alias("occur"),
                ),
            ),
        )
    )

    def having(occur: str) -> Column:
        return F.array_distinct(
            F.transform(
                F.filter("listed", lambda e: e["occur"] == occur),
                lambda e: F.struct(e["scope"].alias("scope"), e["token"].alias("token")),
            )
        )

    rows = queries.select("qid", listed.alias("listed")).select(
        "qid",
        having(SHOULD).alias("s"),
        having(MUST).alias("m"),
        having(MUST_NOT).alias("x"),
    )
    rows = rows.select(
        "qid",
        "s",
        "m",
        "x",
        F.size("m").alias("n_must"),
        F.size(F.array_union("s", "m")).alias("n_positive"),
        F.size("x").alias("n_not"),
    )
    exploded = rows.select(
        "*", F.explode_outer(F.array_union(F.array_union("s", "m"), "x")).alias("t")
    )
    return exploded.select(
        "qid",
        "t.scope",
        "t.token",
        F.array_contains("s", F.col("t")).alias("is_should"),
        F.array_contains("m", F.col("t")).alias("is_must"),
        F.array_contains("x", F.col("t")).alias("is_not"),
        "n_must",
        "n_positive",
        "n_not",
    )


def kind() -> Column:
    """What a query asks for: ``match`` (positive tokens), ``not_only`` or ``all``."""
    return (
        F.when(F.col("n_positive") > 0, F.lit("match"))
        .when(F.col("n_not") > 0, F.lit("not_only"))
        .otherwise(F.lit("all"))
    )


def query_kinds(tokens: DataFrame) -> DataFrame:
    """``(qid, kind)``; every token row of a query carries the same list sizes."""
    return tokens.groupBy("qid").agg(F.first(kind()).alias("kind"))


def weighted(tokens: DataFrame, stats: DataFrame, n_docs: Column) -> DataFrame:
    """Query tokens with their idf; tokens the corpus lacks stay, with no weight."""
    return (
        tokens.filter(F.col("token").isNotNull())
        .join(stats.select("scope", "token", "df", *(c for c in stats.columns if c == "top")), ["scope", "token"], "left")
        .withColumn("weight", F.when(F.col("df") > 0, scoring.idf(n_docs, F.col("df"))))
    )


def token_hits(tokens: DataFrame, posted: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Query tokens meet the postings of the same scope and token.

    ``hot`` (scope, token, splits) lists tokens too frequent for one task.  Their postings
    are dealt over ``splits`` sub-keys by document and their query rows are repeated once
    per sub-key, so each pair still meets exactly once.  It is a short list (see
    :func:`hot_tokens`).  Without ``hot`` the join is left as it is: when the query
    side is small it is broadcast and nothing is shuffled.
    """
    if hot is None:
        return tokens.join(posted, ["scope", "token"])
    left = tokens.join(F.broadcast(hot), ["scope", "token"], "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1))
    )
    right = posted.join(F.broadcast(hot), ["scope", "token"], "left").withColumn(
        "part", F.pmod(F.xxhash64("docid"), F.coalesce("splits", F.lit(1))).cast("int")
    )
    return left.drop("splits").join(right.drop("splits"), ["scope", "token", "part"]).drop("part")


def led_hits(tokens: DataFrame, posted: DataFrame, hot: DataFrame | None = None, few: int = 0) -> DataFrame:
    """Hits of queries with must tokens, found from each query's rarest must token.

    Only documents that hold the rarest one can match, so the other tokens are looked up
    for those documents alone, by (token, document).  Hits then number the rarest token's
    documents times the query's tokens, however frequent the other tokens are, and the
    lookup key is never hot.  Queries with a must token the corpus lacks match nothing.

    Without ``hot`` the queries are few and broadcast.  If the frequencies show that there are at most
    ``few`` such lookups, those are broadcast too, and no posting of a frequent word is shuffled.
    """
    entry = F.struct("scope", "token", "is_should", "is_must", "is_not", "weight")
    asked = (
        tokens.groupBy("qid")
        .agg(
            F.min_by(F.struct("scope", "token"), F.when(F.col("is_must"), F.struct("df", "scope", "token"))).alias("lead"),
            F.max(F.col("is_must") & F.col("df").isNull()).alias("hopeless"),
            F.collect_list(entry).alias("asked"),
            F.first("n_must").alias("n_must"),
            F.first("n_positive").alias("n_positive"),
            F.min(F.when(F.col("is_must"), F.col("df"))).alias("docs"),
        )
        .filter(~F.col("hopeless"))
    )
    lookups = asked.agg(F.sum(F.col("docs") * F.size("asked"))).first()[0] or 0 if hot is None else None
    asked = asked.select("qid", "lead.scope", "lead.token", "asked", "n_must", "n_positive")
    candidates = token_hits(asked if hot is not None else F.broadcast(asked), posted.select("scope", "token", "docid"), hot)
    wanted = candidates.select("qid", "docid", "n_must", "n_positive", F.explode("asked").alias("t")).select(
        "qid", "docid", "n_must", "n_positive", "t.*"
    )
    if lookups is not None and lookups <= few:
        wanted = F.broadcast(wanted)
    return posted.join(wanted, ["scope", "token", "docid"])


def hot_tokens(stats: DataFrame, hot_df: int = HOT_DF) -> DataFrame:
    """All tokens above ``hot_df``: one row per so many postings at most, so short enough to broadcast."""
    return stats.filter(F.col("df") > hot_df).select("scope", "token", F.ceil(F.col("df") / hot_df).cast("int").alias("splits"))


def evaluate(hits: DataFrame, avg_dl: Column) -> DataFrame:
    """Hits to one row per (query, document) with list counts and the BM25 sum."""
    positive = F.col("is_should") | F.col("is_must")
    share = scoring.term_score(F.col("weight"), F.col("tf"), F.col("dl"), avg_dl)
    return hits.groupBy("qid", "docid").agg(
        F.count_if("is_should").alias("hit_should"),
        F.count_if("is_must").alias("hit_must"),
        F.count_if("is_not").alias("hit_not"),
        F.max("n_must").alias("n_must"),
        F.max("n_positive").alias("n_positive"),
        F.round(F.coalesce(F.sum(F.when(positive, share)), F.lit(0.0)), scoring.DIGITS).alias("score"),
    )


def evaluate_should(hits: DataFrame, avg_dl: Column) -> DataFrame:
    """:func:`evaluate` and :func:`matching` for queries of should tokens only: the sum is all."""
    share = scoring.term_score(F.col("weight"), F.col("tf"), F.col("dl"), avg_dl)
    return hits.groupBy("qid", "docid").agg(F.round(F.sum(share), scoring.DIGITS).alias("score"))


def matching(evaluated: DataFrame) -> DataFrame:
    """Documents that satisfy a query with positive tokens: ``(qid, docid, score)``.

    Every must token, no must-not token, and at least one should token unless there are
    must tokens; next to must tokens the should tokens only add to the score.
    """
    return evaluated.filter(
        (F.col("n_positive") > 0)
        & (F.col("hit_not") == 0)
        & (F.col("hit_must") == F.col("n_must"))
        & ((F.col("n_must") > 0) | (F.col("hit_should") > 0))
    ).select("qid", "docid", "score")

