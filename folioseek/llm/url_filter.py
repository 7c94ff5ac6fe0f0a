"""URL filter: listed rules first, then association rules mined from labels.

Labelled pages are transactions of URL tokens and their class.  FP-growth finds the frequent token
combinations; those that occur with the blocked class often enough, and mostly with it, are
rules, whatever their length and whether or not a part of them is one.  Tokens that always stand together are one item,
and a rule of items stands for all the rules of their tokens, so a long path that pages share is not 2^n combinations.
A rule is indexed under its rarest token, so a page is tested only against rules one of whose tokens it has.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import FILE, ROW, numbered
from folioseek.session import staged

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BLOCKED = "class:block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> dict[str, Column]:
    """host and path as columns, and what else tokens come from; empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return {
        "scheme": F.when(at > 0, F.translate(url.substr(F.lit(1), at - 1), _UPPER, _LOWER)).otherwise(""),
        "host": host,
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract(rest, r"^[^#]*#([\s\S]*)$", 1),
    }


def url_tokens() -> Column:
    """Distinct tokens of the columns of ``url_parts``: scheme, host labels, path pieces, query keys, fragment.

    Digits are replaced, so numbered pages share their tokens.
    """
    shape = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    tokens = F.concat(
        F.array(F.concat(F.lit("s:"), "scheme"), F.concat(F.lit("f:"), shape(F.col("fragment")))),
        F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.split(shape(F.col("path")), "/"), lambda x: F.concat(F.lit("p:"), x)),
        F.transform(F.split("query", "&"), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0])),
    )
    return F.filter(F.array_distinct(tokens), lambda x: F.length(x) > 2)


def listed_rule(rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits ``host`` and ``path``; null without one.

    Of rules of one length the one with the longer host wins.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        text, verdict = F.when(fits, host + path).otherwise(text), F.when(fits, action).otherwise(verdict)
    return text, verdict


def token_items(labelled: DataFrame, needed: int) -> DataFrame:
    """``(token, item, n, blocked)`` of tokens in ``needed`` blocked pages or more; ``labelled`` is ``(page, tokens, bad)``.

    Tokens of the same labelled pages share their item, the smallest of them.  Sums of page hashes tell which
    tokens may; whether each of their pages holds the item is then counted.
    """
    each = labelled.select("page", "tokens", "bad", F.explode("tokens").alias("token"))
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "page")).alias(f"h{seed}")
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("blocked"), mark(1), mark(2))
    counts = staged(counts.filter(F.col("blocked") >= needed), "tokens")
    first = counts.groupBy("n", "blocked", "h1", "h2").agg(F.min("token").alias("item"))
    shared = counts.join(first, ["n", "blocked", "h1", "h2"]).filter(F.col("item") != F.col("token")).select("token", "item")
    held = each.join(shared, "token").groupBy("token", "item").agg(F.count_if(F.array_contains("tokens", F.col("item"))).alias("both"))
    same = counts.join(held, "token", "left")
    return same.select("token", F.when(F.col("both") == F.col("n"), F.col("item")).otherwise(F.col("token")).alias("item"), "n", "blocked")


def as_items(rows: DataFrame, items: DataFrame, *keys: str) -> DataFrame:
    """The keys of ``rows`` and the item of each of their ``tokens`` that has one; rows without any are left out."""
    each = rows.select(*keys, F.explode("tokens").alias("token")).join(items, "token")
    return each.groupBy(*keys).agg(F.collect_list("item").alias("items"))


def rules_and_others(frequent: DataFrame, min_confidence: float) -> DataFrame:
    """``(items, n, blocked, size, rule)`` of the sets frequent with the blocked class, from sets with that class or not."""
    bare = frequent.filter(~F.array_contains("items", BLOCKED)).select("items", F.col("freq").alias("n"))
    with_class = frequent.filter(F.array_contains("items", BLOCKED) & (F.size("items") > 1))
    sets = with_class.select(F.array_remove("items", BLOCKED).alias("items"), F.col("freq").alias("blocked")).join(bare, "items")
    return staged(sets.withColumns({"size": F.size("items"), "rule": F.col("blocked") / F.col("n") >= min_confidence}), "sets")


def minimal_rules(sets: DataFrame) -> DataFrame:
    """``(items, n, blocked)`` of the rules among ``sets`` no part of which is a rule.

    All parts of a frequent set are frequent, so a set has a rule inside if one of the sets that lack one of its
    items is a rule or has one inside: sets are settled by size, each met by its own parts alone.
    """
    longest = sets.agg(F.max("size")).first()[0] or 0
    found, settled = sets.filter("false"), None
    for size in range(1, longest + 1):
        now = sets.filter(F.col("size") == size).withColumn("inside", F.lit(False))
        if settled is not None:
            parts = now.select("items", F.explode("items").alias("less")).select("items", F.array_remove("items", F.col("less")).alias("part"))
            over = parts.join(settled.select(F.col("items").alias("part")), "part").select("items").distinct()
            now = now.drop("inside").join(over.withColumn("inside", F.lit(True)), "items", "left")
        now = staged(now.withColumn("inside", F.coalesce("inside", F.lit(False))), "settled")
        found = found.unionByName(now.filter("rule AND NOT inside").drop("inside"))
        settled = now.filter("rule OR inside")
    return found.select("items", "n", "blocked")


def mine_rules(labelled: DataFrame, *, min_support: float = 0.005, min_count: int = 5, min_confidence: float = 0.6, minimal: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rules ``(items, lead, n, blocked)`` from rows ``(tokens, bad)``, and ``(token, item)`` of the tokens they may hold.

    A rule's tokens occur with the blocked class in at least ``min_count`` pages and that share of
    all labelled pages, and at least ``min_confidence`` of the pages with the tokens are blocked; if ``minimal``,
    no part of it is a rule.  Tokens of the same labelled pages are one item.  ``lead`` is the rarest item.
    Without labelled pages there are no rules.
    """
    spark = labelled.sparkSession
    known = labelled.filter("bad IS NOT NULL AND tokens IS NOT NULL").select(F.expr("uuid()").alias("page"), "tokens", "bad")
    known = staged(known, "transactions")
    total = known.count()
    if not total:
        return spark.range(0).selectExpr("array(string(id)) AS items", "string(id) AS lead", "id AS n", "id AS blocked"), spark.range(0).selectExpr("string(id) AS token", "string(id) AS item")
    needed = max(min_count, math.ceil(min_support * total))
    items = staged(token_items(known, needed), "items")
    # Minimal rules of one item are taken out beforehand: no other rule holds them.
    alone = (F.col("blocked") / F.col("n") >= min_confidence) & F.lit(minimal)
    single = items.filter(alone & (F.col("token") == F.col("item"))).select(F.array("item").alias("items"), F.col("item").alias("lead"), "n", "blocked")
    rest = as_items(known, items.filter(~alone).select("token", "item"), "page", "bad").withColumn("items", F.array_distinct("items"))
    baskets = staged(rest.select(F.when(F.col("bad"), F.array_append("items", BLOCKED)).otherwise(F.col("items")).alias("items")), "baskets")
    left = baskets.count()
    rules = single
    if left:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (needed - 0.5) / left), minConfidence=1.0).fit(baskets)
        frequent = staged(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
        sets = rules_and_others(frequent, min_confidence)
        longer = minimal_rules(sets) if minimal else sets.filter("rule")
        of = items.filter(F.col("token") == F.col("item")).select(F.col("item").alias("lead"), F.col("n").alias("of_lead"))
        leads = longer.withColumn("lead", F.explode("items")).join(of, "lead").groupBy("items", "n", "blocked")
        rules = rules.unionByName(leads.agg(F.min(F.struct("of_lead", "lead"))["lead"].alias("lead")).select("items", "lead", "n", "blocked"))
    return staged(rules, "rules"), items.select("token", "item")


def near(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """Broadcast if all values together, measured, are few bytes; else left to the planner."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))) * 2)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def ways(needed: Column, items: Column) -> Column:
    """How many sets of a page's tokens are the items ``needed``, one token of each or more; null beyond a long."""
    held = lambda x: F.size(F.filter(items, lambda y: y == x))
    some = lambda x: F.when(held(x) < 63, F.pow(F.lit(2), held(x)).cast("bigint") - 1)
    return F.aggregate(needed, F.lit(1).cast("bigint"), lambda n, x: F.try_multiply(n, some(x)))


def filter_urls(
    pages: DataFrame, labels: DataFrame, *, rules=RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", **mining
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, mined (mined rules that fit a page no listed one does).

    A listed rule decides; else a page is blocked if a mined rule fits and allowed if none does.  All sets of tokens
    that are rules count as mined, the largest long if they are more.
    A page's label is the row of ``labels`` with its id: bad if quality is 0 or toxic is 1 (bad if any of
    several rows is); null marks alone label nothing.  A null url or one without ``://`` has empty
    host and path, no tokens and is allowed.  Repeated rows and null ids are judged like any
    other; an empty table gives none.
    """
    rows = numbered(pages, page_id=F.col(id_col), url=F.col(url_col))
    rows = rows.withColumns(url_parts(F.col("url")))
    text, verdict = listed_rule(rules)
    judged = staged(
        rows.withColumns({"rule": text, "listed": verdict, "tokens": F.when(F.length("host") + F.length("path") > 0, url_tokens()).otherwise(F.array())})
        .select(FILE, ROW, "page_id", "host", "path", "rule", "listed", "tokens"),
        "judged",
    )
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1)
    marks = labels.select(F.col(label_id).alias("page_id"), bad.alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))
    marks = staged(marks, "marks")
    rules, items = mine_rules(judged.join(marks, "page_id").select("tokens", "bad"), minimal=False, **mining)
    rules, items = near(rules.select(F.col("items").alias("needed"), "lead")), near(items)

    open_pages = as_items(judged.filter("listed IS NULL"), items, FILE, ROW)
    hits = (
        open_pages.select(FILE, ROW, "items", F.explode(F.array_distinct("items")).alias("lead"))
        .join(rules, "lead")
        .filter(F.size(F.array_except("needed", "items")) == 0)
        .select(FILE, ROW, ways(F.col("needed"), F.col("items")).alias("ways"))
        .groupBy(FILE, ROW).agg(F.when(F.count("ways") == F.count(F.lit(1)), F.try_sum("ways")).alias("mined"))
        .withColumn("mined", F.coalesce("mined", F.lit(2**63 - 1)))
    )
    mined = F.coalesce("mined", F.lit(0))
    return judged.join(hits, [FILE, ROW], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", F.when(mined > 0, "block").otherwise("allow")).alias("verdict"), mined.alias("mined"),
    )
