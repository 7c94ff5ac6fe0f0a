"""Top-k of should queries without scoring every posting: largest term shares by token and block of documents.

Documents are dealt to blocks by hash.  For each frequent token and block the largest term share (without the
idf) of its postings is kept, for each token the largest of all.  A query takes four steps:

1. The documents with its rarest tokens are scored; the k-th best score is a threshold the page has to reach.
2. Its tokens are put in order of the most they can add.  Cheap ones that together stay below the threshold can not
   bring a document onto the page alone, so only postings of the others make candidates.
3. A candidate's score so far and what its block allows the cheap tokens to add must reach the threshold.
4. The cheap tokens are looked up for surviving candidates alone, dearest first, with step 3 after each layer.

The first k rows are those of scoring everything, ties included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..session import staged
from .paging import top_per_group
from .retrieve import token_hits
from .sorting import RELEVANCE, Sort

#: Documents of a block on average, and in how many documents a token must at least be to have shares by block.
BLOCK_DOCS = 64
FREQUENT = 64
#: Where the cheap tokens, dearest last, are cut into layers.
LAYERS = (0.75, 0.5, 0.25)
#: Candidates for the threshold, times the page's end.
FIRST = 4
# Sums in another order differ in the last bits: what is this close to the threshold stays.
_SLACK = 1e-7


def _share(avg_dl: Column) -> Column:
    return scoring.term_score(F.lit(1.0), F.col("tf"), F.col("dl"), avg_dl)


def block_of(n_docs: int) -> Column:
    return F.pmod(F.xxhash64("docid"), F.lit(max(1, -(-n_docs // BLOCK_DOCS))))


def token_tops(posted: DataFrame, avg_dl: Column) -> DataFrame:
    """``(scope, token, df, top)``: document frequency and largest share of each token."""
    return posted.groupBy("scope", "token").agg(F.count(F.lit(1)).alias("df"), F.max(_share(avg_dl)).alias("top"))


def frequent_df(n_docs: int) -> int:
    """In how many documents a token must be to have shares by block: one in BLOCK_DOCS, so that a block saves something.

    Such tokens are at most BLOCK_DOCS times as many as a document has on average, however many documents there are.
    """
    return max(FREQUENT, -(-n_docs // BLOCK_DOCS))


def block_tops(posted: DataFrame, stats: DataFrame, n_docs: int, avg_dl: Column) -> DataFrame:
    """``(scope, token, block, top)`` of frequent tokens; the others are left out before anything is grouped."""
    frequent = stats.filter(F.col("df") >= frequent_df(n_docs)).select("scope", "token")
    by_block = posted.join(F.broadcast(frequent), ["scope", "token"], "left_semi").groupBy("scope", "token", block_of(n_docs).alias("block"))
    return by_block.agg(F.max(_share(avg_dl)).alias("top"))


class TopShould:
    """``found``: ``(qid, docid, score)`` with at least the first ``k`` rows of every query; ``hits``: the postings scored.

    ``tokens`` is ``(qid, scope, token, weight, df, top)`` of queries with should tokens alone, written down.
    ``small`` says that they are few enough to broadcast.  Up to ``few`` candidates, counted, are broadcast too.
    """

    def __init__(
        self, tokens: DataFrame, posted: DataFrame, blocks: DataFrame, n_docs: int, avg_dl: Column, k: int,
        small: bool, few: int, hot: DataFrame | None = None,
    ):
        self.tokens = tokens.filter("df > 0").select("qid", "scope", "token", "weight", "df", "top")
        self.posted = posted.select("scope", "token", "docid", "tf", "dl")
        self.blocks, self.n_docs, self.avg_dl, self.k = blocks, n_docs, avg_dl, k
        self.small, self.few, self.hot = small, few, hot
        self.hits: list[DataFrame] = []
        self.found = self._found()

    def _near(self, tokens: DataFrame) -> DataFrame:
        return F.broadcast(tokens) if self.small else tokens

    def _score(self, hits: DataFrame) -> DataFrame:
        self.hits.append(hits)
        share = scoring.term_score(F.col("weight"), F.col("tf"), F.col("dl"), self.avg_dl)
        return hits.groupBy("qid", "docid").agg(F.sum(share).alias("partial"))

    def _all_hits(self, tokens: DataFrame) -> DataFrame:
        tokens = tokens.select("qid", "scope", "token", "weight")
        return token_hits(self._near(tokens), self.posted, self.hot)

    def _looked_up(self, rows: DataFrame, tokens: DataFrame, few: bool) -> DataFrame:
        """Hits of the tokens in the rows' documents alone.

        A few rows are broadcast and postings are filtered where they are read; else postings are met
        by (token, document), a key that is never hot.
        """
        tokens, rows = tokens.select("qid", "scope", "token", "weight"), rows.select("qid", "docid")
        if self.small and few:
            return token_hits(F.broadcast(tokens), self.posted).join(F.broadcast(rows), ["qid", "docid"])
        return self.posted.join(rows.join(tokens, "qid"), ["scope", "token", "docid"])

    def _thresholds(self) -> DataFrame:
        """``(qid, theta)`` of the queries whose rarest tokens are in enough documents."""
        rarest = Window.partitionBy("qid").orderBy("df", "scope", "token").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("df").over(rarest), F.lit(0))
        lead = self.tokens.withColumn("before", before).filter(F.col("before") < FIRST * self.k)
        first = self._score(self._all_hits(lead))
        best = top_per_group(first, ["qid"], [F.desc("partial"), F.asc("docid")], FIRST * self.k)
        full = self._score(self._looked_up(best, self.tokens, True))  # a small batch: FIRST * k rows a query at most
        last = top_per_group(full, ["qid"], [F.desc("partial"), F.asc("docid")], self.k)
        return last.filter(F.col("rank") == self.k).select("qid", (F.col("partial") - _SLACK).alias("theta"))

    def _layered(self) -> DataFrame:
        """Tokens with ``theta`` and their layer; 0 makes candidates."""
        most = F.col("weight") * F.col("top")
        cheap = Window.partitionBy("qid").orderBy("most", "scope", "token")
        rows = self.tokens.withColumn("most", most).join(self._near(self._thresholds()), "qid", "left")
        rows = rows.withColumn("theta", F.coalesce("theta", F.lit(0.0))).withColumn("below", F.sum("most").over(cheap) < F.col("theta"))
        rows = rows.withColumns({"place": F.row_number().over(cheap), "n": F.count_if("below").over(Window.partitionBy("qid"))})
        layer: Column = F.lit(len(LAYERS) + 1)
        for i, part in reversed(list(enumerate(LAYERS, 1))):
            layer = F.when(F.col("place") > F.col("n") * part, i).otherwise(layer)
        return staged(rows.select("qid", "scope", "token", "weight", "df", "most", "theta", F.when(F.col("below"), layer).otherwise(0).alias("layer")), "layers")

    def _found(self) -> DataFrame:
        tokens = self._layered()
        layers = range(1, len(LAYERS) + 2)
        cheap = tokens.filter("layer > 0")
        rest = lambda most: [F.sum(F.when(F.col("layer") >= i, most).otherwise(0.0)).alias(f"b{i}") for i in layers]
        names = [f"b{i}" for i in layers]
        shares = cheap.filter(F.col("df") >= frequent_df(self.n_docs)).select("qid", "scope", "token", "weight", "layer")
        allowed = self.blocks.join(self._near(shares), ["scope", "token"]).groupBy("qid", "block").agg(*rest(F.col("weight") * F.col("top")))
        always = tokens.groupBy("qid").agg(
            F.first("theta").alias("theta"),
            *[F.sum(F.when((F.col("layer") >= i) & (F.col("df") < frequent_df(self.n_docs)), F.col("most")).otherwise(0.0)).alias(f"a{i}") for i in layers],
        )
        at = self._score(self._all_hits(tokens.filter("layer = 0"))).withColumn("block", block_of(self.n_docs))
        at = at.join(allowed, ["qid", "block"], "left").join(self._near(always), "qid")
        alive = at.select("qid", "docid", "partial", "theta", *((F.coalesce(b, F.lit(0.0)) + F.col(f"a{b[1:]}")).alias(b) for b in names))
        for i in layers:
            alive = staged(alive.filter(F.col("partial") + F.col(f"b{i}") >= F.col("theta")), "alive")
            layer = cheap.filter(F.col("layer") == i)
            added = self._score(self._looked_up(alive, layer, alive.count() <= self.few))
            kept = ["theta", *names[i:]]
            both = alive.select("qid", "docid", "partial", *kept).unionByName(added, allowMissingColumns=True)
            alive = both.groupBy("qid", "docid").agg(F.sum("partial").alias("partial"), *(F.max(c).alias(c) for c in kept))
        return alive.filter("partial >= theta").select("qid", "docid", F.round("partial", scoring.DIGITS).alias("score"))


def first_by_score(keys: Sequence[Sort]) -> bool:
    """Whether the result list starts with the largest scores."""
    return bool(keys) and all(k.field == RELEVANCE for k in keys) and keys[0].direction != "asc"
