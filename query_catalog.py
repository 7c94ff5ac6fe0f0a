"""The registered queries: each operator of the library run over the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioseek import Field, IndexSpec
from folioseek.functions import query_strings, text
from folioseek.functions.coerce import render
from folioseek.operators import mutate, paging, postings, project, proximity, report, retrieve
from folioseek.operators.filters import Filter, predicate
from folioseek.operators.paging import Page
from folioseek.operators.sorting import RELEVANCE, Sort
from folioseek.operators.typed import accepted, typed_read
from folioseek.plans.collection import Collection
from folioseek.plans.search import Search, query_frame
from folioseek.session import scratch_path, spread
from folioseek.sources import readers
from folioseek.streaming.ingest import ingest, json_lines_stream, table_stream

DOCUMENTS = IndexSpec.of(
    "documents",
    [
        Field("doc_id", "i64", pk=True),
        Field("text"),
        Field("lang", tokenizer="none"),
        Field("source", tokenizer="none"),
        Field("n_chars", "i64"),
    ],
)
LABELLED = IndexSpec.of(
    "labelled", [*DOCUMENTS.fields, Field("quality", "i8"), Field("toxic", "bool")]
)
PARTS = IndexSpec.of(
    "parts",
    [
        Field("p_partkey", "i64", pk=True),
        Field("p_name"),
        Field("p_brand", tokenizer="zh"),
        Field("p_type"),
        Field("p_size", "u8"),
        Field("p_retailprice", "f64"),
    ],
)
ORDERS = IndexSpec.of(
    "orders",
    [
        Field("o_orderkey", "i64", pk=True),
        Field("o_custkey", "int"),
        Field("o_orderstatus", tokenizer="none"),
        Field("o_totalprice", "f64"),
        Field("o_orderdate", "datetime", sorting="desc"),
        Field("o_orderpriority", tokenizer="space"),
    ],
)
LINES = IndexSpec.of(
    "lines",
    [
        Field("l_orderkey", "i64", pk=True),
        Field("l_linenumber", "u8", pk=True),
        Field("l_quantity", "i32"),
        Field("l_extendedprice", "float"),
        Field("l_shipdate", "date", sorting="asc"),
    ],
)
TURNS = IndexSpec.of(
    "turns",
    [
        Field("conv_id", "i64", pk=True),
        Field("turn", "i32", pk=True),
        Field("role", tokenizer="none"),
        Field("text", tokenizer="zh"),
    ],
)
EVENTS = IndexSpec.of(
    "events",
    [
        Field("user_id", "u64", pk=True),
        Field("event_id", "i64"),
        Field("event_type", tokenizer="none"),
        Field("value", "f64"),
        Field("props", "json"),
        Field("ts", "datetime", time_fmt="yyyy-MM-dd HH:mm:ss.SSSSSS"),
    ],
)
CUSTOMERS = IndexSpec.of(
    "customers",
    [
        Field("c_custkey", "i64", pk=True),
        Field("c_name", tokenizer="none"),
        Field("c_nationkey", "i16"),
        Field("c_acctbal", "f64"),
        Field("c_mktsegment", tokenizer="none"),
    ],
)
NATIONS = IndexSpec.of(
    "nations",
    [Field("n_nationkey", "u8", pk=True), Field("n_name", tokenizer="none"), Field("n_regionkey", "u8")],
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(spark: SparkSession, sf_dir: str, name: str, spec: IndexSpec) -> DataFrame:
    """A given table as typed documents ``(docid, doc)``."""
    return accepted(typed_read(readers.from_table(table(spark, sf_dir, name)), spec)).select("docid", "doc")


_built: dict[tuple[str, str, str], Collection] = {}


def versioned(name: str, df: DataFrame) -> tuple[DataFrame, str | None]:
    """Line items repeat keys: the row with the greatest version wins."""
    if name == "lineitem":
        return df.withColumn("version", F.col("l_partkey") * 100000 + F.col("l_suppkey")), "version"
    return df, None


def index_of(spark: SparkSession, sf_dir: str, name: str, spec: IndexSpec) -> Collection:
    """The index of a given table, built once per session and then searched."""
    key = (spark.sparkContext.applicationId, sf_dir, spec.name)
    if key not in _built:
        index = Collection(spark, scratch_path(spark, f"index-{spec.name}"), spec)
        rows, seq = versioned(name, table(spark, sf_dir, name))
        index.build(readers.from_table(rows, seq), unique=seq is None)
        _built[key] = index
    return _built[key]


def joined(positions: Column) -> Column:
    return F.concat_ws(",", positions)


def shown_score() -> Column:
    return F.round("score", 5).alias("score")


# -- text and postings ------------------------------------------------------------------


def tokenize_space(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    t = docs.select("doc_id", text.tokens(F.col("text"), text.SPACE).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.concat_ws("|", "t").alias("tokens"))


def tokenize_han(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"), "page_id")
    t = pages.select("page_id", text.tokens(F.col("html"), text.HAN).alias("t"))
    return t.select("page_id", F.size("t").alias("n_tokens"), F.concat_ws("|", "t").alias("tokens"))


def postings_global(spark, sf):
    docs = spread(documents_of(spark, sf, "documents", DOCUMENTS), "docid")
    p = postings.postings(docs, DOCUMENTS, "global")
    return p.select("docid", "token", "tf", joined(F.col("positions")).alias("positions"), "dl")


def postings_by_field(spark, sf):
    p = postings.postings(documents_of(spark, sf, "part", PARTS), PARTS)
    return p.select("docid", "scope", "token", "tf", joined(F.col("positions")).alias("positions"), "dl")


def postings_json_field(spark, sf):
    """String values of a JSON field are analysed, other JSON values are not."""
    spec = IndexSpec.of("j", [Field("event_id", "i64", pk=True), Field("payload", "json")])
    raw = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, F.col("event_type").cast("variant"))
        .otherwise(F.parse_json("props"))
        .alias("payload"),
    )
    docs = accepted(typed_read(readers.from_table(raw), spec)).select("docid", "doc")
    p = postings.postings(docs, spec, "field")
    return p.select("docid", "scope", "token", "tf", joined(F.col("positions")).alias("positions"))


def corpus_stats(spark, sf):
    docs = spread(documents_of(spark, sf, "documents", DOCUMENTS), "docid")
    stats = postings.corpus_stats(postings.doc_lengths(docs, DOCUMENTS))
    return stats.select("n_docs", F.round("avg_dl", 6).alias("avg_dl"))


def token_document_frequency(spark, sf):
    index = index_of(spark, sf, "documents", DOCUMENTS)
    return index.tables().stats.filter(F.col("scope") == postings.GLOBAL).select("token", "df")


# -- retrieval ----------------------------------------------------------------------------


def _search(spark, sf, clauses, **options) -> Search:
    queries = query_frame(spark, [(1, clauses)])
    return index_of(spark, sf, "documents", DOCUMENTS).search(queries, **options)


def _all_matches(spark, sf, clauses):
    s = _search(spark, sf, clauses, sort=[Sort(RELEVANCE)])
    return s.matches.select("qid", "docid", shown_score())


def search_should(spark, sf):
    return _all_matches(spark, sf, [(None, "the thre", "should"), (None, "und", "should")])


def search_must(spark, sf):
    return _all_matches(spark, sf, [(None, "the of", "must")])


def search_mixed(spark, sf):
    return _all_matches(
        spark, sf, [(None, "the", "must"), (None, "thre in", "should"), (None, "tion", "must_not"), (None, "le", "must_not")]
    )


def search_not_only(spark, sf):
    s = _search(spark, sf, [(None, "the", "must_not"), (None, "der", "must_not")], page=Page.of(2, 50))
    return s.page_ids.join(s.totals, "qid").select("qid", "rank", "docid", "total")


def search_not_only_batch(spark, sf):
    """One excluding query per benchmark text, every one with its own page."""
    queries = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.array(retrieve.clause(F.col("text"), "must_not")).alias("clauses")
    )
    s = index_of(spark, sf, "documents", DOCUMENTS).search(queries, page=Page.of(1, 10))
    return s.page_ids.join(s.totals, "qid").select("qid", "rank", "docid", "total")


def search_match_all(spark, sf):
    s = _search(spark, sf, [], page=Page.of(3, 40))
    return s.page_ids.join(s.totals, "qid").select("qid", "rank", "docid", "total")


def search_field(spark, sf):
    """Per part type: that word in its field, or a word anywhere; lists are shared."""
    types = table(spark, sf, "part").select(F.col("p_type").alias("qid")).distinct()
    queries = types.select(
        "qid",
        F.array(
            retrieve.clause(F.col("qid"), "should", "p_type"),
            retrieve.clause(F.lit("red"), "should"),
            retrieve.clause(F.lit("#7"), "must_not", "p_brand"),
            retrieve.clause(F.lit("anything"), "must", "no_such_field"),
        ).alias("clauses"),
    )
    s = index_of(spark, sf, "part", PARTS).search(queries, sort=[Sort(RELEVANCE)])
    return s.matches.select("qid", "docid", shown_score())


def bm25_topk_batch(spark, sf):
    queries = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.array(retrieve.clause(F.col("text"), "should")).alias("clauses")
    )
    s = index_of(spark, sf, "documents", DOCUMENTS).search(queries, sort=[Sort(RELEVANCE)], page=Page.of(1, 10))
    return s.page_ids.select("qid", "rank", "docid", shown_score())


def search_filtered_topk(spark, sf):
    s = _search(
        spark,
        sf,
        [(None, "the", "must"), (None, "thre", "should")],
        filters=[Filter("lang", ["en"]), Filter("n_chars", ranges=[("500", None)])],
        sort=[Sort(RELEVANCE)],
        page=Page.of(1, 10),
        fields=["doc_id", "lang", "source", "n_chars"],
    )
    return s.page.select("rank", "doc_id", "lang", "source", "n_chars", shown_score())


def pagination_summary(spark, sf):
    queries = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.array(retrieve.clause(F.col("text"), "must")).alias("clauses")
    )
    s = index_of(spark, sf, "documents", DOCUMENTS).search(queries, page=Page.of(1, 7))
    return s.summary


def search_query_strings(spark, sf):
    """Strings as users type them, one per whole benchmark text, with an in-field part."""
    w = F.split("text", " ")
    typed = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.concat(F.lit("+"), w[0], F.lit(" -"), w[1], F.lit('  "'), w[2], F.lit('" "'), w[3], F.lit(" "), w[4], F.lit('" + '), w[5], F.lit(" "), F.array_join(F.slice(w, 9, F.greatest(F.size(w), F.lit(1))), " ")).alias("q"),
        F.concat(F.lit("text:"), w[6], F.lit(" -"), w[7], F.lit(",nothing;:x;lang:en")).alias("fq"),
    )
    queries = typed.select("qid", query_strings.clauses(F.col("q"), F.col("fq")).alias("clauses"))
    s = index_of(spark, sf, "documents", DOCUMENTS).search(
        queries, filters=query_strings.filters("lang:en,fr;n_chars:300~"), sort=query_strings.sorts("_score,doc_id:asc"), page=Page.of(1, 20)
    )
    return s.page_ids.select("qid", "rank", "docid", shown_score())


_HAN_DOCUMENTS = IndexSpec.of("han", [Field("doc_id", "i64", pk=True), Field("text", tokenizer="zh")])


def search_han(spark, sf):
    """Han text, one token per character: vowels of documents and queries become Han characters."""
    han = lambda c: F.translate(c, "aeiou", "这是测试中")
    docs = table(spark, sf, "documents").select("doc_id", han("text").alias("text"))
    index = Collection(spark, scratch_path(spark, "han"), _HAN_DOCUMENTS)
    index.build(readers.from_table(docs), unique=True)
    queries = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.array(retrieve.clause(han("text"), "should")).alias("clauses"),
    )
    s = index.search(queries, sort=[Sort(RELEVANCE)], page=Page.of(1, 5))
    return s.page_ids.select("qid", "rank", "docid", shown_score())


def proximity_spread(spark, sf):
    """How far apart the words of a clause stand in each document that holds them."""
    clauses = [(1, [(None, "of the", "must")]), (2, [(None, "la le", "must")]), (3, [(None, "in the and", "must")])]
    index = index_of(spark, sf, "documents", DOCUMENTS)
    s = index.search(query_frame(spark, clauses), max_proximity=proximity.MAX_PROXIMITY)
    ordered = retrieve.clause_tokens(s.queries, DOCUMENTS)
    return proximity.proximity(ordered, s.postings).select("qid", "docid", "proximity")


def search_proximity(spark, sf):
    s = _search(spark, sf, [(None, "of the", "must")], max_proximity=proximity.MAX_PROXIMITY, sort=[Sort(RELEVANCE)])
    return s.matches.select("qid", "docid", shown_score())


# -- filters --------------------------------------------------------------------------------


def _orders_where(spark, sf, filters, combine="and"):
    docs = documents_of(spark, sf, "orders", ORDERS)
    return docs.filter(predicate(filters, ORDERS, combine)).select(
        "doc.o_orderkey", "doc.o_orderstatus", "doc.o_orderpriority", "doc.o_totalprice"
    )


def filter_numeric_or_range(spark, sf):
    return _orders_where(
        spark,
        sf,
        [Filter("o_totalprice", ranges=[(None, "5000"), (100000, 150000.5), ("bad", "7")]), Filter("o_custkey", ["12", "x"])],
    ).unionByName(
        _orders_where(spark, sf, [Filter("o_totalprice", ranges=[("1000", "20000")]), Filter("no_such", [1]), Filter("o_custkey", ["x"])])
    )


def filter_values_and_ranges(spark, sf):
    """Values and ranges of one field must both hold, or either with combine="or"."""
    both = Filter("o_custkey", [5, 7, 11, 700], [("6", "20")])
    strict = _orders_where(spark, sf, [both]).withColumn("mode", F.lit("and"))
    return strict.unionByName(_orders_where(spark, sf, [both], "or").withColumn("mode", F.lit("or")))


def filter_string_by_tokenizer(spark, sf):
    docs = documents_of(spark, sf, "part", PARTS)
    parts = [
        (PARTS, "space", Filter("p_name", ["red", "ring"])),
        (PARTS, "zh", Filter("p_brand", ["#1"])),
    ]
    out = None
    for spec, kind, f in parts:
        rows = docs.filter(predicate([f], spec)).select(F.lit(kind).alias("kind"), "docid")
        out = rows if out is None else out.unionByName(rows)
    status = documents_of(spark, sf, "orders", ORDERS).filter(predicate([Filter("o_orderstatus", ["F"])], ORDERS))
    return out.unionByName(status.select(F.lit("none").alias("kind"), "docid"))


def filter_text_token(spark, sf):
    docs = spread(documents_of(spark, sf, "documents", DOCUMENTS), "docid")
    return docs.filter(predicate([Filter("text", ["thre"]), Filter("lang", ranges=[("en", "es")])], DOCUMENTS)).select("docid")


def filter_time_range(spark, sf):
    docs = documents_of(spark, sf, "orders", ORDERS)
    f = Filter("o_orderdate", ["1996-02-29 00:00:00", "1997-13-01 00:00:00"]), Filter(
        "o_orderdate", ranges=[("1995-06-01 00:00:00", "1996-06-30 00:00:00"), ("2001-01-01 00:00:00", "")]
    )
    exact = docs.filter(predicate([f[0]], ORDERS)).select(F.lit("exact").alias("kind"), "docid")
    return exact.unionByName(docs.filter(predicate([f[1]], ORDERS)).select(F.lit("range").alias("kind"), "docid"))


def filter_bool_and_json(spark, sf):
    spec = IndexSpec.of(
        "flags",
        [Field("event_id", "i64", pk=True), Field("big", "bool"), Field("kind", "json", tokenizer="none"), Field("value", "json")],
    )
    raw = table(spark, sf, "events").select(
        "event_id",
        (F.col("value") > 10).alias("big"),
        F.col("event_type").cast("variant").alias("kind"),
        F.col("value").cast("variant").alias("value"),
    )
    docs = accepted(typed_read(readers.from_table(raw), spec)).select("docid", "doc")
    cases = {
        "bool": Filter("big", ["yes"]),
        "bool range": Filter("big", ranges=[("false", "true")]),
        "json text": Filter("kind", ["click"]),
        "json text range": Filter("kind", ranges=[("d", "q")]),
        "json number as text": Filter("value", ["1"]),
    }
    out = None
    for name, f in cases.items():
        rows = docs.filter(predicate([f], spec)).select(F.lit(name).alias("kind"), "docid")
        out = rows if out is None else out.unionByName(rows)
    return out


# -- sort and page --------------------------------------------------------------------------


def _page(spark, sf, name, spec, columns, **options):
    s = index_of(spark, sf, name, spec).search(query_frame(spark, [(1, [])]), **options)
    return s.page.select("rank", *columns)


def sort_multi(spark, sf):
    return _page(
        spark, sf, "customer", CUSTOMERS, [F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_custkey"],
        sort=[Sort("c_nationkey", "asc"), Sort("no_such_field"), Sort("c_acctbal")], page=Page.of(2, 100),
    )


def sort_negative_ascending(spark, sf):
    return _page(
        spark, sf, "customer", CUSTOMERS, ["c_acctbal", "c_custkey"], sort=[Sort("c_acctbal", "asc")], page=Page.of(1, 100)
    )


def sort_by_text(spark, sf):
    return _page(
        spark, sf, "part", PARTS, ["p_name", "p_partkey"],
        sort=[Sort("p_name", "asc", as_text=True), Sort("p_partkey", "desc")], page=Page.of("junk", 1000),
    )


def sort_bool_json_missing(spark, sf):
    """A bool key, a JSON number and a field that some rows lack, which come last in both directions."""
    spec = IndexSpec.of(
        "keys", [Field("event_id", "i64", pk=True), Field("click", "bool"), Field("amount", "json"), Field("third", "i32")]
    )
    raw = table(spark, sf, "events").select(
        "event_id",
        (F.col("event_type") == "click").alias("click"),
        F.when(F.col("event_id") % 4 != 0, F.floor("value")).cast("variant").alias("amount"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 7).alias("third"),
    )
    index = Collection(spark, scratch_path(spark, "keys"), spec, buckets=1)
    index.build(readers.from_table(raw), unique=True)
    out = None
    for name, keys in {
        "bool": [Sort("click"), Sort("event_id", "asc")],
        "json": [Sort("amount", "asc"), Sort("event_id")],
        "json last": [Sort("amount"), Sort("event_id", "asc")],
        "missing": [Sort("third"), Sort("click", "asc"), Sort("event_id", "asc")],
    }.items():
        for page in (Page.of(1, 60), Page.of(90, 100)):
            s = index.search(query_frame(spark, [(1, [])]), sort=keys, page=page)
            rows = s.page_ids.select(F.lit(name).alias("kind"), "rank", "docid")
            out = rows if out is None else out.unionByName(rows)
    return out


def sort_default(spark, sf):
    """Declared order (newest first), then the id."""
    return _page(spark, sf, "orders", ORDERS, ["o_orderdate", "docid"], page=Page.of(2, -5))


def sort_string_by_relevance(spark, sf):
    """A string key sorts by the whole-number score, equal scores by the next key."""
    s = _search(
        spark, sf, [(None, "the thre", "should")], sort=[Sort("text"), Sort("n_chars", "asc")], page=Page.of(1, 50)
    )
    return s.page.select("rank", "doc_id", "n_chars")


def page_window(spark, sf):
    """A deep page of line items under a compound key."""
    return _page(
        spark, sf, "lineitem", LINES, ["docid", "l_shipdate", "l_quantity"],
        filters=[Filter("l_quantity", ranges=[(10, 12)])], page=Page.of(21, 20),
    )


def deep_page_per_query(spark, sf):
    """Ranks past the early cut, for every market segment at once."""
    orders = documents_of(spark, sf, "orders", ORDERS).select(
        F.col("doc.o_orderstatus").alias("qid"), "docid", F.col("doc.o_totalprice").alias("k0")
    )
    top = paging.top_per_group(orders, ["qid"], [F.desc("k0"), F.asc("docid")], 1200)
    return top.filter(F.col("rank") > 1150).select("qid", "rank", "docid")


# -- typed read -------------------------------------------------------------------------------

COERCED = IndexSpec.of(
    "coerced",
    [
        Field("event_id", "i64", pk=True),
        Field("small", "i8"),
        Field("unsigned", "u16"),
        Field("real", "f64"),
        Field("flag", "bool"),
        Field("day", "date"),
        Field("at", "datetime"),
        Field("clock", "time"),
        Field("word", "str"),
        Field("props", "json"),
        Field("seconds", "timestamp"),
    ],
)


def _raw_events(spark, sf) -> DataFrame:
    """Events as JSON texts with the value in many shapes, some of them unusable."""
    e = spread(table(spark, sf, "events"), "event_id")
    n = F.col("event_id")
    cents = F.floor(F.col("value") * 100).cast("bigint")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = e.select(
        "event_id",
        F.to_json(
            F.struct(
                F.when(n % 97 != 0, n).alias("event_id"),
                F.when(n % 11 == 0, F.lit("")).otherwise(F.floor("value").cast("bigint").cast("string")).alias("small"),
                cents.alias("unsigned"),
                F.when(n % 13 == 0, F.lit("1.5e3")).when(n % 17 == 0, F.lit(" 2 ")).otherwise(F.lit("-.5")).alias("real"),
                F.when(n % 3 == 0, F.lit("YES")).when(n % 3 == 1, F.lit("0")).otherwise(F.lit("maybe")).alias("flag"),
                F.substring(stamp, 1, 10).alias("day"),
                F.when(n % 19 == 0, F.lit("no date")).otherwise(stamp).alias("at"),
                F.substring(stamp, 12, 8).alias("clock"),
                F.when(n % 5 != 0, F.col("event_type")).alias("word"),
                F.lit("dropped").alias("undeclared"),
                F.col("user_id").alias("seconds"),
            )
        ).alias("value"),
    )
    return raw.select(
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("source"), F.lit(0).cast("bigint").alias("block"), F.col("event_id").alias("pos")).alias("seq"),
        F.try_parse_json("value").alias("payload"),
        F.lit(None).cast("string").alias("error"),
    )


def coerce_types(spark, sf):
    good = accepted(typed_read(_raw_events(spark, sf), COERCED))
    show = {f.name: render(F.col("doc")[f.name], f, COERCED.zone) for f in COERCED.fields}
    return good.select(
        "docid",
        show["small"].cast("int").alias("small"),
        "doc.unsigned",
        "doc.real",
        "doc.flag",
        show["day"].alias("day"),
        show["at"].alias("at"),
        "doc.clock",
        show["clock"].alias("clock_shown"),
        "doc.word",
        "doc.seconds",
    )


def ingest_report(spark, sf):
    rows = report.report(typed_read(_raw_events(spark, sf), COERCED))
    return rows.select(F.col("seq.pos").alias("pos"), "docid", "error")


def ingest_summary(spark, sf):
    return report.batch_summary(typed_read(_raw_events(spark, sf), COERCED), COERCED.name)


def coerce_table(spark, sf):
    """Typed columns into other declared types."""
    spec = IndexSpec.of(
        "mixed",
        [
            Field("c_custkey", "str", pk=True),
            Field("c_name", tokenizer="none"),
            Field("c_nationkey", "bool"),
            Field("c_acctbal", "u16"),
            Field("c_mktsegment", "f32"),
        ],
    )
    raw = table(spark, sf, "customer").withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise(F.lit("0.25"))
    ).withColumn("c_name", F.concat(F.lit(" \t"), F.col("c_name"), F.lit("　\n")))
    t = typed_read(readers.from_table(raw), spec)
    return t.select(
        F.col("seq.pos").isNotNull().alias("has_seq"), "docid", "doc.c_name", "doc.c_nationkey", "doc.c_acctbal",
        F.col("doc.c_mktsegment").cast("double").alias("c_mktsegment"), "error",
    )


def docid_compound(spark, sf):
    docs = documents_of(spark, sf, "lineitem", LINES)
    return docs.select("docid", "doc.l_orderkey", F.col("doc.l_linenumber").cast("int").alias("l_linenumber"))


# -- sources ----------------------------------------------------------------------------------


def _written(spark, sf, fmt) -> str:
    """The orders table as files of one format, made by Spark."""
    path = scratch_path(spark, f"orders-{fmt}")
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    if fmt == "csv":
        o.repartition(4, "o_orderkey").write.option("header", True).csv(path)
    elif fmt == "jsonl":
        broken = F.col("o_orderkey") % 100 == 0
        line = F.when(broken, F.concat(F.lit("{broken "), F.col("o_orderkey").cast("string"))).otherwise(F.to_json(F.struct("*")))
        o.repartition(4, "o_orderkey").select(line.alias("value")).write.text(path)
    else:
        # Arrays of a thousand orders, each its own file.
        arrays = o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("part")).agg(
            F.to_json(F.collect_list(F.struct(*o.columns))).alias("value")
        )
        arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _orders_read(typed: DataFrame) -> DataFrame:
    return typed.select(
        "docid", F.col("doc.o_custkey").alias("o_custkey"), "doc.o_orderstatus", "doc.o_totalprice",
        render(F.col("doc.o_orderdate"), ORDERS.get("o_orderdate"), ORDERS.zone).alias("o_orderdate"),
        "doc.o_orderpriority", "error",
    )


def read_csv(spark, sf):
    return _orders_read(typed_read(readers.read(spark, _written(spark, sf, "csv"), "text/csv", multiline=False), ORDERS))


def read_csv_headers(spark, sf):
    """Whole texts with line breaks and quotes; half the files have another column order, and one column more."""
    path = scratch_path(spark, "headers")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text", "source")
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.filter("doc_id % 2 = 0").select("doc_id", "lang", "text").write.options(**options).csv(f"{path}/even")
    docs.filter("doc_id % 2 <> 0").select("text", "source", "doc_id", "lang").write.options(**options).csv(f"{path}/odd")
    rows = readers.read(spark, [f"{path}/even", f"{path}/odd"], "csv")
    return rows.select(F.col("payload.doc_id").cast("bigint").alias("doc_id"), "payload.lang", "payload.text", "payload.source", "error")


def read_csv_bad_rows(spark, sf):
    """Rows with a cell too few or too many become error rows that keep their text."""
    path = scratch_path(spark, "uneven")
    key = F.col("o_orderkey")
    line = (
        F.when(key % 50 == 1, F.concat_ws(",", key, "o_custkey"))
        .when(key % 50 == 2, F.concat_ws(",", key, "o_custkey", F.lit("P"), F.lit("1"), F.repeat(F.lit("long "), 100)))
        .otherwise(F.concat_ws(",", key, "o_custkey", "o_orderstatus", F.lit("2.5")))
    )
    lines = table(spark, sf, "orders").select(line.alias("value"))
    header = spark.range(0, 1, 1, 1).select(F.lit("o_orderkey,o_custkey,o_orderstatus,o_totalprice").alias("value"))
    (
        lines.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(3)))
        .unionByName(header.withColumn("part", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(3))))))
        .repartition(3, "part").sortWithinPartitions("part", F.col("value").startswith("o_").desc())
        .write.partitionBy("part").text(path)
    )
    spec = IndexSpec.of("uneven", [Field("o_orderkey", "i64", pk=True), Field("o_custkey", "i64"), Field("o_orderstatus"), Field("o_totalprice", "f64")])
    rows = typed_read(readers.read(spark, path, "csv", multiline=False), spec)
    return rows.select("docid", F.col("doc.o_custkey").alias("o_custkey"), F.col("doc.o_totalprice").alias("o_totalprice"), "error", "stage")


def read_json_lines(spark, sf):
    return _orders_read(typed_read(readers.read(spark, _written(spark, sf, "jsonl"), "jsonl"), ORDERS))


def read_json_array(spark, sf):
    return _orders_read(typed_read(readers.read(spark, _written(spark, sf, "json"), "application/json"), ORDERS))


# -- mutations ----------------------------------------------------------------------------------


def upsert_latest(spark, sf):
    versions = typed_read(readers.from_table(table(spark, sf, "events"), seq="event_id"), EVENTS)
    now = mutate.latest(accepted(versions).select("docid", "seq", "doc"))
    return now.select("docid", "doc.event_id", "doc.event_type", "doc.value")


def partial_update(spark, sf):
    """Labels overlaid on the documents they belong to."""
    docs = documents_of(spark, sf, "documents", LABELLED)
    updates = accepted(typed_read(readers.from_table(table(spark, sf, "labels")), LABELLED))
    out = mutate.partial_update(updates, docs, LABELLED)
    return out.select(
        "docid", "doc.lang", "doc.n_chars", F.col("doc.quality").cast("int").alias("quality"), "doc.toxic",
        F.length("doc.text").alias("text_chars"),
    )


def update_unmatched(spark, sf):
    """Updates of documents that do not exist."""
    docs = documents_of(spark, sf, "part", PARTS)
    raw = table(spark, sf, "lineitem").select((F.col("l_partkey") * 3).alias("p_partkey"), F.lit(1).alias("p_size"))
    updates = accepted(typed_read(readers.from_table(raw), PARTS))
    return mutate.unmatched_updates(updates, docs).select("docid", "error")


def delete_many(spark, sf):
    docs = documents_of(spark, sf, "documents", DOCUMENTS).select("docid", "doc", F.lit(mutate.UPSERT).alias("op"), F.lit(0).alias("batch"))
    bad = table(spark, sf, "labels").filter(F.col("toxic") == 1).select("doc_id")
    gone = mutate.delete_rows(bad, DOCUMENTS).withColumn("batch", F.lit(1))
    return mutate.live(docs.unionByName(gone), order="batch").select("docid", "doc.lang")


def mixed_operations(spark, sf):
    """The events as one mixed batch on the even documents: purchases write, views and clicks update, others delete."""
    spec = IndexSpec.of("mixed", [Field("doc_id", "i64", pk=True), Field("lang"), Field("n_chars", "i64"), Field("kind")])
    index = Collection(spark, scratch_path(spark, "mixed"), spec, buckets=16)
    docs = table(spark, sf, "documents")
    index.append(readers.from_table(docs.filter("doc_id % 2 = 0").select("doc_id", "lang", "n_chars")))
    n = docs.count()
    key, kind = F.pmod(F.col("user_id"), F.lit(n)), F.pmod(F.col("event_id") * 7 + F.floor(F.col("event_id") / 5), F.lit(10))
    events = table(spark, sf, "events").select(
        "event_id", key.alias("doc_id"), F.when(kind % 2 == 1, F.col("event_id")).alias("n_chars"),
        F.when(kind % 3 != 1, F.col("event_type")).alias("kind"),
        F.when(kind < 2, mutate.DELETE).when(kind < 4, mutate.UPSERT).otherwise(mutate.UPDATE).alias("op"),
    )
    ops = readers.from_table(events.drop("op"), seq="event_id").withColumn("op", F.lit(None).cast("string"))
    op = events.select(F.col("event_id").alias("pos"), F.col("op").alias("does"))
    ops = ops.join(op, F.col("seq.pos") == op["pos"]).select("seq", "payload", "error", F.col("does").alias("op"))
    index.apply(ops)
    return index.docs().select("docid", "doc.lang", "doc.n_chars", "doc.kind")


def lookup_by_key(spark, sf):
    docs = documents_of(spark, sf, "conversations", TURNS)
    keys = table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"), F.lit("1").alias("turn"))
    return mutate.lookup(keys, docs, TURNS).select("docid", "doc.role")


def docid_collisions(spark, sf):
    """Distinct keys that print the same id."""
    spec = IndexSpec.of("clash", [Field("a", pk=True), Field("b", pk=True)])
    n = table(spark, sf, "part")
    left = n.select(F.concat_ws("_", F.col("p_partkey"), F.col("p_size")).alias("a"), F.col("p_type").alias("b"))
    right = n.filter(F.col("p_size") < 10).select(
        F.col("p_partkey").cast("string").alias("a"), F.concat_ws("_", F.col("p_size"), F.col("p_type")).alias("b")
    )
    return mutate.docid_collisions(typed_read(readers.from_table(left.unionByName(right)), spec), spec)


def collection_cycle(spark, sf):
    """Append, update and delete as batches, a snapshot in between, then a search."""
    index = Collection(spark, scratch_path(spark, "cycle"), LABELLED, buckets=16)
    labels = table(spark, sf, "labels")
    index.append(readers.from_table(table(spark, sf, "documents")), 0)
    index.compact()
    index.update(readers.from_table(labels), 1)
    index.delete(labels.filter(F.col("toxic") == 1).select("doc_id"), 2)
    s = index.search(
        query_frame(spark, [(1, [(None, "the", "must"), (None, "thre", "should")])]),
        filters=[Filter("quality", ["1"])], sort=[Sort(RELEVANCE)],
    )
    return s.matches.select("docid", shown_score())


# -- streaming ------------------------------------------------------------------------------------


def stream_upsert(spark, sf):
    events = table(spark, sf, "events")
    index = Collection(spark, scratch_path(spark, "stream"), EVENTS, buckets=4)
    # Cut by event number, so that later batches hold later versions.
    files = scratch_path(spark, "event-files")
    events.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(files)
    query = ingest(
        table_stream(spark, files, events.schema), index, scratch_path(spark, "stream-state"), seq="event_id", available_now=True
    )
    query.awaitTermination()
    return index.docs().select("docid", "doc.event_id", "doc.event_type", "doc.value")


def batch_numbers(spark, sf):
    """Two streams with checkpoints of their own, a snapshot between them, and a batch by hand: nothing is lost."""
    orders = table(spark, sf, "orders")
    index = Collection(spark, scratch_path(spark, "numbers"), ORDERS, buckets=2)
    for part in (0, 1):
        files = scratch_path(spark, "order-files")
        orders.filter(F.col("o_orderkey") % 3 == part).repartition(2).write.parquet(files)
        stream = table_stream(spark, files, orders.schema, files_per_batch=1)
        ingest(stream, index, scratch_path(spark, "stream-state"), seq="o_orderkey", available_now=True).awaitTermination()
        index.compact()
    index.append(readers.from_table(orders.filter(F.col("o_orderkey") % 3 == 2)))
    return index.docs().select("docid", "doc.o_custkey", "doc.o_orderstatus", "doc.o_totalprice")


def stream_summary(spark, sf):
    """Totals of the per-batch completion summaries of a JSON Lines stream."""
    path = _written(spark, sf, "jsonl")
    index = Collection(spark, scratch_path(spark, "stream"), ORDERS, buckets=4)
    query = ingest(
        json_lines_stream(spark, path, files_per_batch=2), index, scratch_path(spark, "stream-state"), available_now=True
    )
    query.awaitTermination()
    return index.summaries().groupBy("index", "code").agg(
        F.sum("docs").alias("docs"), F.sum("unreadable").alias("unreadable"), F.sum("failed").alias("failed")
    )


# -- output -----------------------------------------------------------------------------------------


def time_format(spark, sf):
    spec = IndexSpec.of(
        "shown",
        [
            Field("o_orderkey", "i64", pk=True),
            Field("o_orderdate", "date", time_fmt="dd/MM/yyyy"),
            Field("at", "datetime", time_fmt="yyyyMMdd HHmmss"),
        ],
    )
    raw = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderdate") + F.expr("interval 3661 seconds")).alias("at"))
    docs = accepted(typed_read(readers.from_table(raw), spec))
    return docs.select(*project.output_columns(None, spec))


def json_output(spark, sf):
    raw = table(spark, sf, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")))
    docs = accepted(typed_read(readers.from_table(raw), NATIONS))
    return docs.select("docid", project.json_document(["n_name", "n_nationkey", "n_regionkey"], NATIONS).alias("json"))


def output_fields(spark, sf):
    docs = documents_of(spark, sf, "customer", CUSTOMERS)
    return docs.select(*project.output_columns(["c_acctbal", "c_custkey"], CUSTOMERS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokenize_space, tokenize_han, postings_global, postings_by_field, postings_json_field, corpus_stats,
        token_document_frequency, search_should, search_must, search_mixed, search_not_only,
        search_not_only_batch, search_match_all, search_field, bm25_topk_batch, search_filtered_topk,
        mixed_operations, pagination_summary, proximity_spread, search_proximity, filter_numeric_or_range,
        filter_values_and_ranges, filter_string_by_tokenizer, filter_text_token, filter_time_range,
        filter_bool_and_json, sort_multi, sort_negative_ascending, sort_by_text, sort_default,
        sort_string_by_relevance, page_window, deep_page_per_query, coerce_types, ingest_report,
        ingest_summary, coerce_table, docid_compound, read_csv, read_csv_headers, read_json_lines, read_json_array,
        upsert_latest, partial_update, update_unmatched, delete_many, lookup_by_key, docid_collisions,
        search_query_strings, search_han, sort_bool_json_missing, read_csv_bad_rows, batch_numbers,
        collection_cycle, stream_upsert, stream_summary, time_format, json_output, output_fields,
    )
}
