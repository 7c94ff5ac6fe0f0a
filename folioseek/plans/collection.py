"""A collection on shared storage: a log of batches, and snapshots that fold it in.

    <path>/log/rows/batch=N       every input row of a batch, rejected ones with the reason
    <path>/log/docs/batch=N       the batch's last version of each document
    <path>/log/postings/batch=N   its postings, by token bucket
    <path>/log/counts/batch=N     by how much it changes the document frequency of tokens, by token bucket
    <path>/log/corpus/batch=N     by how much it changes the number of documents and of their tokens
    <path>/log/summary/batch=N    one row, written last: a batch counts once it is there
    <path>/snap/gen=G/...         docs, postings, stats, block maxima, corpus folded up to a batch, and the sources of all batches
    <path>/snap/gen=G/parts       the folders, of the log or of earlier snapshots too, that hold its docs and postings

A batch that did not get as far as its summary does not count and its folder is overwritten by the
next one of that number.  A finished one is never overwritten: its number is taken, and a caller
that may run it again names its source.  Plain Parquet, any file system Spark can list.
"""

from __future__ import annotations

import os
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import mutate
from ..operators.block_maxima import block_tops, token_tops
from ..operators.postings import GLOBAL, bulk_postings, corpus_stats, doc_lengths, postings
from ..operators.report import batch_summary, report
from ..operators.typed import accepted, typed_read
from ..session import estimated_bytes, small_batches, spread, staged
from ..spec import IndexSpec
from .search import SMALL_BYTES, Search, Tables, token_bucket

# One bucket should hold some hundred megabytes of postings; large corpora take thousands.
DEFAULT_BUCKETS = 16
# Postings are written as segments, each sorted in its task and cut by bucket: nothing but the documents is shuffled.
# A segment has about this many tokens, so that its postings are sorted in memory, and fewer only to keep the cores busy.
SEGMENT_TOKENS = 3_000_000
LEAST_TOKENS = 250_000
# Files of a layout up to which it is written as segments; beyond, postings are shuffled into buckets.
MANY_FILES = 20_000
# Inputs with at least this many bytes, as estimated, and documents with this many tokens are analysed in whole Arrow batches.
MANY_BYTES = 32 << 20
MANY_TOKENS = 20_000_000
# Folders that a snapshot may take over as they are; with more, documents and postings are written anew into one.
MOST_PARTS = 8
# Smaller batches are not taken over: they are written together, so that a snapshot is made of few large folders.
LEAST_DOCS = 10_000
# The log and the snapshots are most of what is on disk.
PACKED = {"compression": "zstd"}
POSTINGS = "scope string, token string, docid string, tf int, positions array<int>, dl int"
STATS = "scope string, token string, df bigint, top double, bucket int"
BLOCKS = "scope string, token string, block bigint, top double, bucket int"
COUNTS = "scope string, token string, df bigint, batch bigint, bucket int"
CORPUS = "n_docs bigint, avg_dl double"
CHANGE = "n_docs bigint, tokens bigint, batch bigint"
SUMMARY = "index string, docs bigint, unreadable bigint, failed bigint, code int, msg string, source string, batch bigint"
SOURCES = "source string, batch bigint"
PARTS = "docs string, postings string"


class Collection:
    def __init__(self, spark: SparkSession, path: str, spec: IndexSpec, buckets: int = DEFAULT_BUCKETS):
        self.spark, self.path, self.spec, self.buckets = spark, path, spec, buckets
        # Where one field makes up the whole text, its postings are those of the document, ``dl`` places on: they
        # are kept once, under the document, and spelled out when read.
        analysed = [f.name for f in spec.fields if f.has_text]
        self._alone = analysed[0] if len(analysed) == 1 else None
        self._kept = "global" if self._alone else "both"
        if self._exists(self._at("meta")):
            stored = self._meta()
            if stored != buckets:
                raise ValueError(f"{path} has {stored} token buckets, not {buckets}")

    def _meta(self) -> int:
        return self.spark.read.schema("buckets int").parquet(self._at("meta")).first().buckets

    def _one_row(self, path: str, mode: str, **values) -> None:
        row = self.spark.range(0, 1, 1, 1).select(*[(F.lit(v) if isinstance(v, int) else v).alias(k) for k, v in values.items()])
        row.write.mode(mode).parquet(path)

    def _schema(self, table: str) -> T.StructType | str:
        """Declared schemas: no inference job, and an empty folder is an empty table."""
        if table == "docs":
            return T.StructType(
                [
                    T.StructField("docid", T.StringType()),
                    T.StructField("op", T.StringType()),
                    T.StructField("doc", self.spec.struct_type()),
                    T.StructField("dl", T.IntegerType()),
                    T.StructField("batch", T.LongType()),
                ]
            )
        fixed = {
            "postings": f"{POSTINGS}, bucket int",
            "log postings": f"{POSTINGS}, batch bigint, bucket int",
            "stats": STATS,
            "blocks": BLOCKS,
            "counts": COUNTS,
            "corpus": CORPUS,
            "log corpus": CHANGE,
            "summary": SUMMARY,
            "sources": SOURCES,
        }
        return fixed[table]

    # -- folders ----------------------------------------------------------------------

    def _at(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def _exists(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def _committed(self, after: int, before: int | None = None) -> list[int]:
        """Numbers of the finished batches that no snapshot covers yet."""
        if not self._exists(self._at("log", "summary")):
            return []
        rows = self.summaries().filter(F.col("batch") > after).select("batch").distinct().collect()
        numbers = (int(r.batch) for r in rows)
        return sorted(n for n in numbers if before is None or n < before)

    def _log(self, table: str, batches: list[int]) -> DataFrame:
        paths = [self._at("log", table, f"batch={b}") for b in batches]
        reader = self.spark.read.option("basePath", self._at("log", table))
        if table != "rows":
            reader = reader.schema(self._schema(f"log {table}" if table in ("postings", "corpus") else table))
        return self._once(reader.parquet(*paths))

    def _once(self, rows: DataFrame) -> DataFrame:
        """Rows as they are kept; earlier versions wrote those of a lone field too."""
        return rows.filter(F.col("scope") == GLOBAL) if self._alone and "scope" in rows.columns else rows

    def _spelled(self, rows: DataFrame | None) -> DataFrame | None:
        """Kept rows under all their scopes; a filter on the scope leaves one reading of them."""
        if rows is None or not self._alone:
            return rows
        own = rows.withColumn("scope", F.lit(self._alone))
        if "positions" in rows.columns:
            own = own.withColumn("positions", F.transform("positions", lambda p: p + F.col("dl")))
        return rows.withColumn("scope", F.lit(GLOBAL)).unionByName(own)

    def _snapshot(self) -> tuple[int, int] | None:
        """(generation, last batch folded in) of the newest complete snapshot."""
        if not self._exists(self._at("snap", "done")):
            return None
        row = (
            self.spark.read.schema("gen int, upto bigint").parquet(self._at("snap", "done"))
            .agg(F.max_by(F.struct("gen", "upto"), "gen").alias("m"))
            .select("m.gen", "m.upto")
            .first()
        )
        return row.gen, row.upto

    # -- writes -----------------------------------------------------------------------

    def _sources(self, snap: tuple[int, int] | None) -> DataFrame:
        """Source and number of every finished batch."""
        folded = self._snap_table(snap[0], "sources") if snap else self.spark.createDataFrame([], SOURCES)
        if not self._exists(self._at("log", "summary")):
            return folded
        later = self.summaries().filter(F.col("batch") > (snap[1] if snap else -1))
        return folded.unionByName(later.select("source", "batch"))

    def _admit(self, batch: int | None, source: str | None) -> int | None:
        """The number a batch gets, or None if its source is already in the collection.

        Without a number it is the next one.  A number that is not above all finished ones is an
        error: the batch there is another one, or a caller that runs one again gave no source.
        """
        snap = self._snapshot()
        if source is not None and not self._sources(snap).filter(F.col("source") == source).isEmpty():
            return None
        last = max([snap[1] if snap else -1, *self._committed(snap[1] if snap else -1)])
        if batch is None:
            return last + 1
        if batch <= last:
            raise ValueError(f"batch {batch} can not be written: the collection already has batch {last}, and numbers have to rise")
        return batch

    def append(self, docs: DataFrame, batch: int | None = None, source: str | None = None) -> int | None:
        """Add documents from a reader; an id that exists is replaced.

        Returns the batch's number.  ``source`` names what is added: adding it again, with whatever
        number, changes nothing and returns None.
        """
        batch = self._admit(batch, source)
        if batch is None:
            return None
        typed = typed_read(docs, self.spec).withColumn("op", F.lit(mutate.UPSERT))
        rows = self._write_rows(typed, batch)
        winners = mutate.latest_of_few(accepted(rows).select("docid", "seq", "op", "doc"), SMALL_BYTES)
        return self._write_batch(winners.select("docid", "op", "doc"), rows, batch, source)

    def update(self, docs: DataFrame, batch: int | None = None, source: str | None = None) -> int | None:
        """Overlay the given fields on existing documents; unknown ids become error rows."""
        batch = self._admit(batch, source)
        if batch is None:
            return None
        typed = staged(typed_read(docs, self.spec).withColumn("op", F.lit(mutate.UPSERT)), "updates")
        stored = staged(self._touched(typed, batch), "touched")
        typed = typed.join(stored.select("docid", F.lit(True).alias("known")), "docid", "left")
        absent = F.col("error").isNull() & F.col("known").isNull()
        typed = typed.select(
            "seq",
            "docid",
            "doc",
            F.when(absent, F.lit(mutate.NOT_FOUND)).otherwise(F.col("error")).alias("error"),
            F.when(absent, F.lit("convert")).otherwise(F.col("stage")).alias("stage"),
            "op",
        )
        rows = self._write_rows(typed, batch)
        changed = mutate.partial_update(accepted(rows), stored, self.spec)
        return self._write_batch(changed.select("docid", F.lit(mutate.UPSERT).alias("op"), "doc"), rows, batch, source, stored)

    def apply(self, ops: DataFrame, batch: int | None = None, source: str | None = None) -> int | None:
        """Upserts, partial updates and deletes mixed in one batch, as if applied row by row in the order of ``seq``.

        ``ops`` are rows of a reader with a column ``op`` (``mutate.UPSERT``, ``UPDATE`` or ``DELETE``); a delete needs the key fields
        only.  Updates that meet no document at their place become error rows, other values of ``op`` too.  ``seq`` is
        unique.  Stored documents are passed over once.
        """
        batch = self._admit(batch, source)
        if batch is None:
            return None
        known_op = F.coalesce(F.col("op").isin(mutate.UPSERT, mutate.UPDATE, mutate.DELETE), F.lit(False))
        error = F.when(~known_op, F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null"))))
        typed = staged(typed_read(ops.withColumn("error", F.coalesce("error", error)), self.spec), "operations")
        stored = staged(self._touched(typed, batch), "touched")
        lost = mutate.unmatched_operations(accepted(typed), stored).select("seq", F.lit(True).alias("lost"))
        typed = typed.join(lost, "seq", "left").select(
            "seq",
            "docid",
            F.when(F.col("op") != mutate.DELETE, F.col("doc")).alias("doc"),
            F.when(F.col("lost"), F.lit(mutate.NOT_FOUND)).otherwise(F.col("error")).alias("error"),
            F.when(F.col("lost"), F.lit("convert")).otherwise(F.col("stage")).alias("stage"),
            "op",
        )
        rows = self._write_rows(typed, batch)
        return self._write_batch(mutate.fold_operations(accepted(rows), stored, self.spec), rows, batch, source, stored)

    def _touched(self, typed: DataFrame, batch: int) -> DataFrame:
        """The stored documents a batch names: the one pass over all documents, which stay where they are if the ids are few bytes."""
        return self._stored(typed.filter("error IS NULL").select("docid").distinct(), batch)

    def _stored(self, ids: DataFrame, batch: int) -> DataFrame:
        """The documents of distinct ids as they are before a batch.

        Most ids of a large batch are new: ids alone are shuffled to find those ever stored, and documents only if
        these are many.  Last versions are picked among the documents of those ids.
        """
        snap, batches = self._state(batch)
        plain = self._all_live(batches)
        size = mutate.id_bytes(ids)
        if size > SMALL_BYTES:
            ids = staged(mutate.common(ids, self._docs(snap, batches, plain=True)), "stored")
            size = mutate.id_bytes(ids)
        return self._docs(snap, batches, plain, F.broadcast(ids) if size <= SMALL_BYTES else ids)

    def delete(self, ids: DataFrame, batch: int | None = None, source: str | None = None) -> int | None:
        """Drop documents by id (first column of ``ids``); unknown ids are ignored."""
        batch = self._admit(batch, source)
        if batch is None:
            return None
        gone = mutate.delete_rows(ids, self.spec)
        no_seq = F.lit(None).cast("struct<at:bigint,source:string,block:bigint,pos:bigint>")
        none = F.lit(None).cast("string")
        rows = self._write_rows(
            gone.select(no_seq.alias("seq"), "docid", "doc", none.alias("error"), none.alias("stage"), "op"), batch
        )
        return self._write_batch(rows.select("docid", "op", "doc"), rows, batch, source)

    def _write_rows(self, rows: DataFrame, batch: int) -> DataFrame:
        path = self._at("log", "rows", f"batch={batch}")
        rows.write.mode("overwrite").options(**PACKED).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _write_batch(self, versions: DataFrame, rows: DataFrame, batch: int, source: str | None, stored: DataFrame | None = None) -> int:
        path = self._at("log", "docs", f"batch={batch}")
        self._with_length(versions).write.mode("overwrite").options(**PACKED).parquet(path)
        written = self.spark.read.schema(self._schema("docs")).parquet(path)
        docs = written.filter(F.col("op") == mutate.UPSERT)
        self._write_postings(docs, self._at("log", "postings", f"batch={batch}"))
        ids = written.select("docid")  # one row each
        # What a caller passes is staged already.
        gone = staged(self._stored(ids, batch), "replaced") if stored is None else stored.join(ids, "docid", "left_semi")
        self._write_changes(docs, gone.select("docid", "doc", "dl"), batch)
        batch_summary(rows, self.spec.name).withColumn("source", F.lit(source).cast("string")).write.mode("overwrite").parquet(
            self._at("log", "summary", f"batch={batch}")
        )
        return batch

    def _write_changes(self, docs: DataFrame, gone: DataFrame, batch: int) -> None:
        """What a batch adds to the figures of a search: its versions count for it, those they replace against it."""
        new = self._log("postings", [batch]).select("scope", "token", F.lit(1).alias("df"))
        old = postings(gone.select("docid", "doc"), self.spec, self._kept).select("scope", "token", F.lit(-1).alias("df"))
        change = new.unionByName(old).groupBy("scope", "token").agg(F.sum("df").alias("df")).filter("df <> 0")
        self._write_by_bucket(change, self._at("log", "counts", f"batch={batch}"))
        sizes = docs.select(F.lit(1).alias("n"), "dl").unionByName(gone.select(F.lit(-1).alias("n"), (-F.col("dl")).alias("dl")))
        sizes = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
        sizes.write.mode("overwrite").parquet(self._at("log", "corpus", f"batch={batch}"))

    def _figures(self, snap: tuple[int, int] | None, batches: list[int]) -> tuple[DataFrame, DataFrame] | None:
        """Document frequencies and corpus figures as the snapshot's plus each later batch's change; no document is read.

        The snapshot's token count is its mean length times its documents, exact below 2^52 tokens.  None
        if a batch was written without its changes.
        """
        if not all(self._exists(self._at("log", "corpus", f"batch={b}")) for b in batches):
            return None
        stats = self._log("counts", batches).select("scope", "token", "df", "bucket")
        corpus = self._log("corpus", batches).select("n_docs", "tokens")
        if snap:
            stats = stats.unionByName(self._snap_table(snap[0], "stats").select("scope", "token", "df", "bucket"))
            total = F.round(F.col("n_docs") * F.col("avg_dl")).cast("bigint").alias("tokens")
            corpus = corpus.unionByName(self._snap_table(snap[0], "corpus").select("n_docs", total))
        stats = stats.groupBy("scope", "token", "bucket").agg(F.sum("df").alias("df")).filter("df > 0")
        corpus = corpus.agg(F.sum("n_docs").alias("n_docs"), F.sum("tokens").alias("tokens"))
        return stats, corpus.select("n_docs", (F.col("tokens") / F.greatest("n_docs", F.lit(1))).alias("avg_dl"))

    def _with_length(self, docs: DataFrame, many: bool = False) -> DataFrame:
        lengths = doc_lengths(docs.select("*", F.col("doc").alias("kept")), self.spec, many)
        return lengths.withColumnRenamed("kept", "doc")

    def _write_postings(self, docs: DataFrame, path: str) -> None:
        """The postings of written documents ``(docid, doc, dl, ...)``, as segments unless they would make too many files."""
        tokens = docs.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
        cores = self.spark.sparkContext.defaultParallelism
        tokens = tokens if self._alone else 2 * tokens  # posted under two scopes
        segments = max(1, -(-tokens // SEGMENT_TOKENS), min(cores, -(-tokens // LEAST_TOKENS)))
        segments = -(-segments // cores) * cores if segments > cores else segments
        if MANY_FILES < segments * self.buckets <= 2 * MANY_FILES:  # up to twice as large rather than shuffled
            segments = max(1, MANY_FILES // self.buckets)
        docs = docs.select("docid", "doc")
        posted = bulk_postings if self._alone and tokens >= MANY_TOKENS else lambda docs, spec: postings(docs, spec, self._kept)
        with small_batches(self.spark):
            if segments * self.buckets > MANY_FILES:
                self._write_by_bucket(posted(docs, self.spec), path)
            else:
                self._write_by_bucket(posted(docs.repartition(segments, "docid"), self.spec), path, segments=True)

    def _write_by_bucket(self, rows: DataFrame, path: str, segments: bool = False) -> None:
        """One folder per token bucket, tokens in order inside each file; ``segments`` leaves the rows where they are.

        The rebalance hint lets Spark split a bucket that a frequent token has swollen
        over several tasks and files, and join small ones.
        """
        if not self._exists(self._at("meta")):
            self._one_row(self._at("meta"), "overwrite", buckets=self.buckets)
        rows = rows.withColumn("bucket", token_bucket(self.buckets))
        (
            (rows if segments else rows.hint("rebalance", "bucket"))
            .sortWithinPartitions("bucket", "scope", "token")
            .write.mode("overwrite").options(**PACKED)
            .partitionBy("bucket")
            .parquet(path)
        )

    # -- reads ------------------------------------------------------------------------

    def _delta(self, batches: list[int]) -> DataFrame:
        """Last version of each document changed since the snapshot."""
        return mutate.latest(self._log("docs", batches), order="batch")

    def _state(self, before: int | None = None) -> tuple[tuple[int, int] | None, list[int]]:
        snap = self._snapshot()
        return snap, self._committed(snap[1] if snap else -1, before)

    def docs(self, before: int | None = None) -> DataFrame:
        """Current documents ``(docid, doc, dl)``, or those before a batch."""
        snap, batches = self._state(before)
        return self._docs(snap, batches, self._all_live(batches))

    def _docs(self, snap: tuple[int, int] | None, batches: list[int], plain: bool, ids: DataFrame | None = None) -> DataFrame:
        """``plain`` says that all rows of the batches are live: then all rows are read where they lie, without a shuffle.

        With ``ids`` it is the documents of these alone; other rows are left out before last versions are picked.
        """
        named = lambda rows: rows if ids is None else rows.join(ids, "docid", "left_semi")
        parts = []
        if batches:
            delta = named(self._log("docs", batches))
            delta = delta if plain else mutate.latest(delta, order="batch")
            parts.append(delta.filter(F.col("op") == mutate.UPSERT).select("docid", "doc", "dl"))
        if snap:
            base = named(self._snap_table(snap[0], "docs"))
            if batches and not plain:
                base = base.join(delta.select("docid"), "docid", "left_anti")
            parts.append(base.select("docid", "doc", "dl"))
        if not parts:
            return self.spark.createDataFrame([], self._schema("docs")).select("docid", "doc", "dl")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _snap_table(self, gen: int, name: str) -> DataFrame:
        own = os.path.join("snap", f"gen={gen}", name)
        folders = [p[name] for p in self._parts(gen)] if name in ("docs", "postings") else [own]
        reader = self.spark.read.schema(self._schema(name))
        return self._once(reduce(DataFrame.unionByName, [reader.parquet(self._at(f)) for f in folders]))

    def _parts(self, gen: int) -> list[dict[str, str]]:
        """The folders of a snapshot's documents and postings; without a list they are its own."""
        own = {name: os.path.join("snap", f"gen={gen}", name) for name in ("docs", "postings")}
        listed = self._at("snap", f"gen={gen}", "parts")
        return [r.asDict() for r in self.spark.read.schema(PARTS).parquet(listed).orderBy("docs").collect()] if self._exists(listed) else [own]

    def _all_live(self, batches: list[int]) -> bool:
        """Whether all rows of the log are live: the batches added as many documents as they have rows, so nothing was deleted or replaced."""
        if not all(self._exists(self._at("log", "corpus", f"batch={b}")) for b in batches):
            return False
        return not batches or self._log("corpus", batches).agg(F.sum("n_docs")).first()[0] == self._log("docs", batches).count()

    def _mergeless(self, snap: tuple[int, int] | None, batches: list[int]) -> list[dict[str, str]] | None:
        """The folders that together are the folded state as they stand, or None if they are too many, some are small, or some row in them is not live."""
        parts = self._parts(snap[0]) if snap else []
        parts = parts + [{name: os.path.join("log", name, f"batch={b}") for name in ("docs", "postings")} for b in batches]
        if not batches or len(parts) > MOST_PARTS or not self._all_live(batches):
            return None
        sizes = [r["count"] for r in self._log("docs", batches).groupBy("batch").count().collect()]
        return None if len(sizes) < len(batches) or min(sizes) < LEAST_DOCS else parts

    def tables(self) -> Tables:
        """What searches read.  Without changes since the snapshot it is the snapshot."""
        t = self._tables()
        return replace(t, postings=self._spelled(t.postings), stats=self._spelled(t.stats), blocks=self._spelled(t.blocks))

    def _tables(self) -> Tables:
        """:meth:`tables` under the scopes that are kept."""
        snap, batches = self._state()
        docs = self._docs(snap, batches, self._all_live(batches))
        if snap and not batches:
            return Tables(
                docs,
                self._snap_table(snap[0], "postings"),
                self._snap_table(snap[0], "stats"),
                self._snap_table(snap[0], "corpus"),
                self.buckets,
                self._snap_table(snap[0], "blocks") if self._exists(self._at("snap", f"gen={snap[0]}", "blocks")) else None,
            )
        if not batches:
            return Tables(docs, postings(docs.select("docid", "doc"), self.spec, self._kept), None, corpus_stats(docs), None)
        delta = self._delta(batches).select("docid", "batch", "op")
        columns = ["scope", "token", "docid", "tf", "positions", "dl", "bucket"]
        fresh = (
            self._log("postings", batches)
            .join(delta.filter(F.col("op") == mutate.UPSERT), ["docid", "batch"], "left_semi")
            .select(columns)
        )
        if snap:
            base = self._snap_table(snap[0], "postings").join(delta, "docid", "left_anti").select(columns)
            fresh = base.unionByName(fresh)
        stats, corpus = self._figures(snap, batches) or (None, corpus_stats(docs))
        return Tables(docs, fresh, stats, corpus, self.buckets)

    def search(self, queries: DataFrame, **options) -> Search:
        return Search(self.tables(), self.spec, queries, **options)

    def report(self, batch: int) -> DataFrame:
        return report(self._log("rows", [batch]))

    def collisions(self, batch: int) -> DataFrame:
        """Ids of a batch that different keys share, inside it or with documents stored before it."""
        new = self._log("rows", [batch]).filter(F.col("error").isNull() & F.col("doc").isNotNull()).select("docid", "doc")
        old = self.docs(before=batch).join(new.select("docid").distinct(), "docid", "left_semi").select("docid", "doc")
        return mutate.docid_collisions(new.unionByName(old), self.spec)

    def summaries(self) -> DataFrame:
        """One row per finished batch."""
        return self.spark.read.schema(SUMMARY).parquet(self._at("log", "summary"))

    # -- snapshots --------------------------------------------------------------------

    def compact(self) -> None:
        """Fold all finished batches into a new snapshot; searches then read it.

        Large batches of new documents alone are taken over where they lie; else documents and postings are written anew.
        """
        snap, batches = self._state()
        if snap and not batches:
            return
        gen = snap[0] + 1 if snap else 0
        upto = batches[-1] if batches else -1
        parts = self._mergeless(snap, batches)
        if parts is None:
            self._docs(snap, batches, self._all_live(batches)).write.mode("overwrite").options(**PACKED).parquet(self._at("snap", f"gen={gen}", "docs"))
        self._finish(gen, upto, self._sources(snap).filter(F.col("batch") <= upto), parts)

    def build(self, docs: DataFrame, unique: bool = False) -> None:
        """Load a first snapshot straight from a reader, without a log.

        ``unique`` says that no id occurs twice, which saves the shuffle that picks the
        last version.
        """
        if self._snapshot() or self._committed(-1):
            raise ValueError("the collection already holds documents; use append")
        good = accepted(typed_read(docs, self.spec))
        if not unique:
            good = mutate.latest(good.select("docid", "seq", "doc"))
        path = self._at("snap", "gen=0", "docs")
        many = estimated_bytes(good) >= MANY_BYTES
        with small_batches(self.spark):
            self._with_length(spread(good.select("docid", "doc"), "docid"), many).write.mode("overwrite").options(**PACKED).parquet(path)
        self._finish(0, -1, self._sources(None))

    def _finish(self, gen: int, upto: int, sources: DataFrame, parts: list[dict[str, str]] | None = None) -> None:
        """Everything else of a snapshot from its written documents; postings that are not taken over are made anew, which moves less than those of the log."""
        # A list left by a compaction that was cut off is replaced too.
        own = [{name: os.path.join("snap", f"gen={gen}", name) for name in ("docs", "postings")}]
        listed = F.array(*[F.struct(*[F.lit(p[name]).alias(name) for name in ("docs", "postings")]) for p in parts or own])
        self.spark.range(0, 1, 1, 1).select(F.inline(listed)).write.mode("overwrite").parquet(self._at("snap", f"gen={gen}", "parts"))
        docs = self._snap_table(gen, "docs")
        if parts is None:
            self._write_postings(docs, self._at("snap", f"gen={gen}", "postings"))
        posted = self._snap_table(gen, "postings")
        corpus_stats(docs).write.mode("overwrite").parquet(self._at("snap", f"gen={gen}", "corpus"))
        corpus = self._snap_table(gen, "corpus").first()
        mean = F.lit(float(corpus.avg_dl))
        # By bucket like the postings, so that a search reads the buckets it needs.
        self._write_by_bucket(token_tops(posted, mean), self._at("snap", f"gen={gen}", "stats"))
        stats = self._snap_table(gen, "stats")
        self._write_by_bucket(block_tops(posted, stats, corpus.n_docs, mean), self._at("snap", f"gen={gen}", "blocks"))
        sources.write.mode("overwrite").parquet(self._at("snap", f"gen={gen}", "sources"))
        self._one_row(self._at("snap", "done"), "append", gen=gen, upto=F.lit(upto).cast("bigint"))
