"""Batch search: a table of queries in, one page and one summary row per query out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import block_maxima, by_document
from ..operators import filters as flt
from ..operators import paging, project, proximity, retrieve, sorting, survivors
from ..operators.postings import GLOBAL, token_stats
from ..session import staged
from ..spec import IndexSpec

# A query batch with at most this many token rows and bytes is broadcast and prunes the scan; it
# is counted, not guessed.  Larger batches take shuffle joins; results are the same.
SMALL_BATCH = 10_000
SMALL_BYTES = 8 << 20
# Rows of candidates, and of pages, up to which they are broadcast to look up postings and documents.
FEW_ROWS = 200_000
# Postings to score above which a page by relevance is found through block maxima: its steps are jobs of
# their own, which small batches do not pay for.
MANY_HITS = 50_000_000
# Postings to score above which queries that share their words are scored document by document, with the queries' weights in
# each task, and for how many queries a posting is asked on average at least.
MANY_SHARED = 50_000_000
SHARED_BY = 4
# Tokens listed in a scan predicate at most.
LISTED_TOKENS = 1_000


@dataclass(frozen=True)
class Tables:
    """What a search reads.

    ``docs``      (docid, doc, ...), one row per live document
    ``postings``  (scope, token, docid, tf, positions, dl[, bucket])
    ``stats``     (scope, token, df[, top][, bucket]) or None to count the df of the asked tokens
    ``corpus``    one row (n_docs, avg_dl)
    ``buckets``   number of token buckets the postings are partitioned by, or None
    ``blocks``    (scope, token, block, top[, bucket]), the largest term shares by block of documents, or None
    """

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame | None
    corpus: DataFrame
    buckets: int | None = None
    blocks: DataFrame | None = None


def query_frame(spark: SparkSession, queries: Sequence[tuple]) -> DataFrame:
    """A few queries given in place: ``(qid, [(field, text, occur), ...])``."""
    rows = [
        F.struct(
            F.lit(qid).cast("bigint").alias("qid"),
            F.array(*[retrieve.clause(F.lit(text), occur, field) for field, text, occur in clauses])
            .cast(retrieve.CLAUSES)
            .alias("clauses"),
        )
        for qid, clauses in queries
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


class Search:
    """One batch of queries over one set of tables; results are lazy frames."""

    def __init__(
        self,
        tables: Tables,
        spec: IndexSpec,
        queries: DataFrame,
        filters: Sequence[flt.Filter] = (),
        sort: Sequence[sorting.Sort] = (),
        page: paging.Page | None = None,
        fields: Sequence[str] | None = None,
        combine: str = "and",
        max_proximity: int | None = None,
    ):
        project.output_fields(fields, spec)  # unknown fields fail before any job
        self.tables, self.spec, self.queries, self.fields = tables, spec, queries, fields
        self.page_args = page or paging.Page()
        self.keys = sorting.resolve(sort, spec)
        self.predicate = flt.predicate(filters, spec, combine)
        self.max_proximity = max_proximity
        self.tokens = retrieve.query_tokens(queries, spec)

    # -- what the batch looks like ----------------------------------------------------

    @cached_property
    def _figures(self):
        """Token rows, their bytes, the kinds of query (at most three) and the scopes asked, of a batch of any size."""
        return self.tokens.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("bytes"),
            F.collect_set(retrieve.kind()).alias("kinds"),
            F.coalesce(F.bool_or("is_must"), F.lit(False)).alias("musts"),
            F.coalesce(F.bool_or("is_not"), F.lit(False)).alias("nots"),
            F.coalesce(F.bool_or((F.col("n_positive") > 0) & (F.col("n_must") == 0)), F.lit(False)).alias("loose"),
            F.collect_set(F.when(F.col("scope").isin(GLOBAL, *(f.name for f in self.spec.fields)), F.col("scope"))).alias("scopes"),
        ).first()

    @cached_property
    def _sample(self) -> list | None:
        """All token rows of a small batch, None for a large one."""
        if self._figures.rows > SMALL_BATCH or self._figures.bytes > SMALL_BYTES:
            return None
        return self.tokens.select("scope", "token", token_bucket(self.tables.buckets or 1).alias("bucket")).collect()

    def _may_hold(self, kind: str) -> bool:
        return kind in self._figures.kinds

    def _prune(self, rows: DataFrame) -> DataFrame:
        """Cut postings or statistics to the tokens that are asked, in a small batch by the scan itself."""
        rows = rows.filter(F.col("scope").isin(*sorted(self._figures.scopes)) if self._figures.scopes else F.lit(False))
        if self._sample is None:
            return rows.join(self._wanted, ["scope", "token"], "left_semi")
        asked = [r for r in self._sample if r.token is not None]
        if not asked:
            return rows.filter(F.lit(False))
        if self.tables.buckets:
            rows = rows.filter(F.col("bucket").isin(*sorted({r.bucket for r in asked})))
        tokens = sorted({r.token for r in asked})
        if len(tokens) <= LISTED_TOKENS:
            return rows.filter(F.col("token").isin(*tokens))
        listed = self.tokens.filter(F.col("token").isNotNull()).select("scope", "token").distinct()
        return rows.join(F.broadcast(listed), ["scope", "token"], "left_semi")

    @cached_property
    def _wanted(self) -> DataFrame:
        """The distinct tokens of a large batch; broadcast if counted to be few bytes."""
        wanted = staged(self.tokens.filter(F.col("token").isNotNull()).select("scope", "token").distinct(), "wanted")
        size = wanted.agg(F.coalesce(F.sum(F.octet_length("token") + F.octet_length("scope") + 32), F.lit(0))).first()[0]
        return F.broadcast(wanted) if size <= SMALL_BYTES else wanted

    @cached_property
    def postings(self) -> DataFrame:
        """The postings of the tokens that are asked."""
        return self._prune(self.tables.postings)

    @cached_property
    def _docs(self) -> DataFrame:
        """Documents that pass the filters: id and sort keys only."""
        docs = self.tables.docs
        if self.predicate is not None:
            docs = docs.filter(self.predicate)
        return docs.select("docid", *sorting.doc_keys(self.keys, self.spec))

    # -- retrieval --------------------------------------------------------------------

    @cached_property
    def _only_should(self) -> bool:
        return not self._figures.musts and not self._figures.nots

    @cached_property
    def _corpus_row(self):
        return self.tables.corpus.first()

    @cached_property
    def _corpus(self) -> tuple[Column, Column]:
        """Document count and mean length: two numbers, read once and put in the plan."""
        return F.lit(self._corpus_row.n_docs), F.lit(float(self._corpus_row.avg_dl))

    @cached_property
    def _stats(self) -> DataFrame:
        if self.tables.stats is not None:
            return self._prune(self.tables.stats)
        return token_stats(self.postings)

    @cached_property
    def _weighted(self) -> DataFrame:
        return staged(retrieve.weighted(self.tokens, self._stats, self._corpus[0]), "weighted")

    @cached_property
    def _hits(self) -> DataFrame:
        """Hits of the queries with positive tokens; those with must words start from their rarest."""
        posted = self.postings.select("scope", "token", "docid", "tf", "dl")
        small = self._sample is not None
        weighted = self._weighted.filter(F.col("n_positive") > 0)
        columns = ["qid", "docid", *retrieve.ROLES, "n_must", "n_positive", "weight", "tf", "dl"]
        hot = None if small else retrieve.hot_tokens(self._stats)
        parts = []
        if self._figures.musts:
            musts = weighted.filter(F.col("n_must") > 0)
            parts.append(retrieve.led_hits(musts, posted, hot, FEW_ROWS).select(columns))
        loose = weighted.filter(F.col("n_must") == 0)
        if parts and not self._figures.loose:  # else all postings would be dealt out to meet no query
            return parts[0]
        if small:
            # By document first: a posting is shuffled once, however many queries ask for its token.
            parts.append(retrieve.token_hits(F.broadcast(loose), posted.repartition("docid")).select(columns))
        else:
            parts.append(retrieve.token_hits(loose, posted, hot).select(columns))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    @cached_property
    def _evaluated(self) -> DataFrame:
        return retrieve.evaluate(self._hits, self._corpus[1])

    @cached_property
    def matches(self) -> DataFrame:
        """``(qid, docid, score, k...)``: every document each positive query matches."""
        if self._only_should:
            found = retrieve.evaluate_should(self._hits, self._corpus[1])
        else:
            found = retrieve.matching(self._evaluated)
        if self.max_proximity is not None:
            ordered = retrieve.clause_tokens(self.queries, self.spec).filter(
                F.col("occur") != retrieve.MUST_NOT
            )
            far = proximity.too_far(proximity.proximity(ordered, self.postings, found), self.max_proximity)
            found = found.join(far, ["qid", "docid"], "left_anti")
        if self.predicate is None and not sorting.uses_fields(self.keys):
            return found
        return found.join(self._docs, "docid")

    @cached_property
    def _order(self):
        return sorting.orderings(self.keys, self.spec, F.col("score"))

    @cached_property
    def _placed(self) -> DataFrame:
        return survivors.positions(self._unscored, self._order)

    @cached_property
    def _blocks(self) -> DataFrame:
        """Bitmaps of the positions each excluding query rules out, by block; pairs of queries and documents are written nowhere."""
        barring = self._weighted.filter(F.col("n_positive") == 0).select("qid", "scope", "token", "df")
        return staged(survivors.excluded_bits(barring, self.postings, self._placed, self._corpus_row.n_docs, self._sample is not None), "blocks")

    @cached_property
    def _kinds(self) -> DataFrame:
        return retrieve.query_kinds(self.tokens)

    # -- pages ------------------------------------------------------------------------

    @cached_property
    def _plain_top(self) -> bool:
        """Whether the page is the best of should words alone."""
        plain = self.predicate is None and self.max_proximity is None and self._only_should
        return plain and block_maxima.first_by_score(self.keys)

    @cached_property
    def shared(self) -> DataFrame | None:
        """The page's matches without most others, where many queries ask for the same postings."""
        qid = self.queries.schema["qid"]
        if not self._plain_top or isinstance(qid.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            return None
        rows = self._weighted.filter("df > 0").select("qid", "scope", "token", "weight", "df")
        each = rows.groupBy("scope", "token").agg(F.first("df").alias("df"), F.count(F.lit(1)).alias("n"))
        total = each.agg(F.sum("n").alias("rows"), F.sum(F.col("df") * F.col("n")).alias("hits"), F.sum("df").alias("postings")).first()
        many = (total.hits or 0) >= MANY_SHARED and total.hits >= SHARED_BY * total.postings
        if not many or total.rows > FEW_ROWS:
            return None
        asked = rows.drop("df").toArrow()
        if len(asked.column("qid").unique()) * self.page_args.end > FEW_ROWS:
            return None
        posted = self.postings.select("scope", "token", "docid", "tf", "dl")
        return by_document.top_by_document(asked, qid, posted, self._corpus[1], self.page_args.end)

    @cached_property
    def leaders(self) -> block_maxima.TopShould | None:
        """The page's matches without the others, where the page is by relevance and much would be scored."""
        if self.tables.blocks is None or not self._plain_top:
            return None
        if (self._weighted.agg(F.sum("df")).first()[0] or 0) < MANY_HITS:
            return None
        small = self._sample is not None
        posted, hot = self.postings, None if small else retrieve.hot_tokens(self._stats)
        blocks = self._prune(self.tables.blocks)
        return block_maxima.TopShould(
            self._weighted, posted, blocks, self._corpus_row.n_docs, self._corpus[1], self.page_args.end, small, FEW_ROWS, hot
        )

    def _match_page(self) -> DataFrame:
        if self.shared is not None:
            matches = self.shared
        else:
            matches = self.matches if self.leaders is None else self.leaders.found
        top = paging.top_per_group(matches, ["qid"], self._order, self.page_args.end)
        return top.filter(F.col("rank") > self.page_args.offset).select("qid", "docid", "rank", "score")

    @cached_property
    def _unscored(self) -> DataFrame:
        return self._docs.withColumn("score", F.lit(0.0))

    def _plain_page(self, qids: DataFrame) -> DataFrame:
        """The page of all documents, the same for every query in ``qids``.

        It is at most one page long, so it travels as one array value.
        """
        p = self.page_args
        top = paging.window(self._unscored, self._order, p)
        ordered = top.select(
            "docid", F.row_number().over(Window.orderBy(*self._order)).alias("i")
        ).agg(F.sort_array(F.collect_list(F.struct("i", "docid")))["docid"].alias("ids"))
        return qids.select("qid", F.posexplode(ordered.scalar()).alias("i", "docid")).select(
            "qid", "docid", (F.col("i") + (p.offset + 1)).cast("bigint").alias("rank"), F.lit(0.0).alias("score")
        )

    @cached_property
    def page_ids(self) -> DataFrame:
        """``(qid, docid, rank, score)`` of the page of every query."""
        parts = []
        if self._may_hold("match"):
            parts.append(self._match_page())
        plain = []
        if self._may_hold("all"):
            plain.append(self._kinds.filter(F.col("kind") == "all").select("qid"))
        if self._may_hold("not_only"):
            rest = survivors.surviving_page(self._blocks, self._placed, self.page_args)
            parts.append(
                rest.select("qid", "docid", "rank", F.lit(0.0).alias("score"))
            )
            # Queries whose tokens hit nothing that passes the filters exclude nothing.
            plain.append(
                self._kinds.filter(F.col("kind") == "not_only")
                .select("qid")
                .join(self._blocks.select("qid").distinct(), "qid", "left_anti")
            )
        if plain:
            qids = plain[0] if len(plain) == 1 else plain[0].unionByName(plain[1])
            parts.append(self._plain_page(qids))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @cached_property
    def _few_ids(self) -> DataFrame:
        """The page's rows, broadcast unless they may be many: then no document is shuffled to show them."""
        few = self._figures.rows * self.page_args.size <= FEW_ROWS
        return F.broadcast(self.page_ids) if few else self.page_ids

    @cached_property
    def page(self) -> DataFrame:
        """The page with the chosen fields: ``(qid, rank, docid, score, <fields>)``."""
        shown = self.tables.docs.select(
            "docid", F.struct(*project.output_columns(self.fields, self.spec)).alias("shown")
        )
        return shown.join(self._few_ids, "docid").select("qid", "rank", "docid", "score", "shown.*")

    @cached_property
    def json_page(self) -> DataFrame:
        """The page with each document as JSON text: ``(qid, rank, docid, json)``."""
        shown = self.tables.docs.select(
            "docid", project.json_document(self.fields, self.spec).alias("json")
        )
        return shown.join(self._few_ids, "docid").select("qid", "rank", "docid", "json")

    # -- figures ----------------------------------------------------------------------

    @cached_property
    def totals(self) -> DataFrame:
        """``(qid, total)`` of every query, also of those that match nothing."""
        all_docs = self._docs.agg(F.count(F.lit(1)).alias("n"))
        counts = self._kinds
        found = F.lit(0)
        if self._may_hold("match"):
            n = self.matches.groupBy("qid").agg(F.count(F.lit(1)).alias("n_match"))
            counts = counts.join(n, "qid", "left")
            found = F.coalesce("n_match", F.lit(0))
        gone = F.lit(0)
        if self._may_hold("not_only"):
            n = self._blocks.groupBy("qid").agg(F.sum("n").alias("n_gone"))
            counts = counts.join(n, "qid", "left")
            gone = F.coalesce("n_gone", F.lit(0))
        total = found
        if self._may_hold("not_only") or self._may_hold("all"):
            total = F.when(F.col("kind") == "match", found).otherwise(all_docs.scalar() - gone)
        return counts.select("qid", total.cast("bigint").alias("total"))

    @cached_property
    def summary(self) -> DataFrame:
        """Pagination figures per query."""
        return self.totals.select("qid", *paging.figures(F.col("total"), self.page_args))


def token_bucket(buckets: int):
    return F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
