"""Upserts, partial updates, deletes and lookups over versions of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import Raw, convert, key_text
from ..session import staged
from ..spec import IndexSpec

UPSERT, DELETE, UPDATE = "U", "D", "P"
NOT_FOUND = "document to update not found"


def latest(versions: DataFrame, key: str = "docid", order: str = "seq") -> DataFrame:
    """One row per key, the one with the greatest ``order``.

    An aggregate rather than a window: each map task sends one row per key, so a key
    written millions of times is as cheap as any other.
    """
    rest = [c for c in versions.columns if c != key]
    best = versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("v"))
    return best.select(key, *[F.col(f"v.{c}").alias(c) for c in rest])


def repeated(keys: DataFrame, key: str = "docid") -> DataFrame:
    """The keys that occur more than once."""
    return keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)


def common(keys: DataFrame, others: DataFrame, key: str = "docid") -> DataFrame:
    """The keys that both frames have, once each; keys alone are shuffled, one row of a key per map task."""
    sides = keys.select(key, F.lit(1).alias("side")).unionByName(others.select(key, F.lit(2).alias("side")))
    return sides.groupBy(key).agg(F.bit_or("side").alias("sides")).filter("sides = 3").select(key)


def id_bytes(keys: DataFrame, key: str = "docid") -> int:
    """About how large keys are in memory."""
    return keys.agg(F.coalesce(F.sum(F.octet_length(key) + 16), F.lit(0))).first()[0]


def latest_of_few(versions: DataFrame, small_bytes: int, key: str = "docid", order: str = "seq") -> DataFrame:
    """:func:`latest` for written versions of which most are the only one of their key: those stay where they are.

    Keys alone are shuffled to find those that repeat; if these are more than ``small_bytes``, it is :func:`latest` of all.
    """
    keys = F.col(key).isNotNull()
    several = staged(repeated(versions.filter(keys), key), "repeated")
    size = id_bytes(several, key)
    if size > small_bytes or not versions.filter(~keys).isEmpty():
        return latest(versions, key, order)
    if not size:
        return versions
    several = F.broadcast(several)
    return versions.join(several, key, "left_anti").unionByName(latest(versions.join(several, key, "left_semi"), key, order))


def live(versions: DataFrame, order: str = "seq") -> DataFrame:
    """Current documents: last version wins, deleted ids drop out."""
    return latest(versions, order=order).filter(F.col("op") != DELETE)


def delete_rows(ids: DataFrame, spec: IndexSpec) -> DataFrame:
    """Log rows for a list of ids (first column); repeated ids count once."""
    docid = ids.select(F.col(f"`{ids.columns[0]}`").cast("string").alias("docid"))
    return docid.filter(F.col("docid").isNotNull()).distinct().select(
        "docid", F.lit(DELETE).alias("op"), F.lit(None).cast(spec.struct_type()).alias("doc")
    )


def merged_updates(updates: DataFrame, spec: IndexSpec) -> DataFrame:
    """Several updates of one document as one: per field the last value given."""
    fields = [
        F.max_by(F.col("doc")[f.name], F.when(F.col("doc")[f.name].isNotNull(), F.col("seq"))).alias(f"v{i}")
        for i, f in enumerate(spec.fields)
    ]
    return updates.groupBy("docid").agg(*fields).select(
        "docid", F.struct(*[F.col(f"v{i}").alias(f.name) for i, f in enumerate(spec.fields)]).alias("doc")
    )


def partial_update(updates: DataFrame, docs: DataFrame, spec: IndexSpec) -> DataFrame:
    """Overlay the given fields on the stored documents: ``(docid, doc)``.

    In a typed row NULL means absent (a given null has become a value), so overlaying is
    a coalesce per field.
    """
    new = merged_updates(updates, spec).withColumnRenamed("doc", "new")
    old = docs.select("docid", F.col("doc").alias("old"))
    fields = [F.coalesce(F.col("new")[f.name], F.col("old")[f.name]).alias(f.name) for f in spec.fields]
    return new.join(old, "docid").select("docid", F.struct(*fields).alias("doc"))


def unmatched_updates(updates: DataFrame, docs: DataFrame) -> DataFrame:
    """Updates of documents that do not exist, as error rows."""
    return updates.join(docs.select("docid"), "docid", "left_anti").withColumn("error", F.lit(NOT_FOUND))


def fold_operations(ops: DataFrame, docs: DataFrame, spec: IndexSpec) -> DataFrame:
    """What a mix of operations makes of the stored documents, applied in the order of ``seq``: ``(docid, op, doc)``.

    ``ops`` is (seq, docid, op, doc) with upserts, deletes and partial updates.  An upsert or a delete settles every
    field, an update those it gives, so a field's value is that of the last row that settles it, and the last
    row that is no update tells whether there is a document.  One aggregate with map-side combine does both.
    The result has a row per named document that was written or deleted; an id with none but updates that met no document has none.
    """
    settles = F.col("op") != UPDATE
    by = [F.max_by("op", F.when(settles, F.col("seq"))).alias("last")]
    for i, f in enumerate(spec.fields):
        given = settles | F.col("doc")[f.name].isNotNull()
        by += [F.max_by(F.col("doc")[f.name], F.when(given, F.col("seq"))).alias(f"v{i}"), F.max(given).alias(f"set{i}")]
    folded = ops.groupBy("docid").agg(*by)
    stored = docs.select("docid", F.col("doc").alias("old"), F.lit(True).alias("known"))
    fields = [F.when(F.col(f"set{i}"), F.col(f"v{i}")).otherwise(F.col("old")[f.name]).alias(f.name) for i, f in enumerate(spec.fields)]
    op = F.coalesce("last", F.when(F.col("known"), F.lit(UPSERT)))
    return (
        folded.join(stored, "docid", "left")
        .select("docid", op.alias("op"), F.struct(*fields).alias("new"))
        .filter(F.col("op").isNotNull())
        .select("docid", "op", F.when(F.col("op") == UPSERT, F.col("new")).alias("doc"))
    )


def unmatched_operations(ops: DataFrame, docs: DataFrame) -> DataFrame:
    """``(seq, docid)`` of the updates in a mix that meet no document: none is stored, or it was deleted before and not written again.

    The operations of one id are sorted in one task, without their documents.
    """
    earlier = Window.partitionBy("docid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") != UPDATE, F.col("op")), ignorenulls=True).over(earlier)
    placed = ops.select("seq", "docid", "op").withColumn("last", last).filter(F.col("op") == UPDATE)
    stored = docs.select("docid", F.lit(UPSERT).alias("known"))
    met = F.coalesce("last", "known", F.lit(DELETE))
    return placed.join(stored, "docid", "left").filter(met == DELETE).select("seq", "docid")


def docid_of(keys: DataFrame, spec: IndexSpec) -> Column:
    """The document id built from key columns of ``keys``."""
    types = {s.name: s.dataType for s in keys.schema.fields}
    missing = [f.name for f in spec.keys if f.name not in types]
    if missing:
        raise ValueError(f"key columns missing: {missing}")
    parts = [
        key_text(convert(Raw.of_column(F.col(f"`{f.name}`"), types[f.name], spec.zone), f, spec.zone), f)
        for f in spec.keys
    ]
    # concat gives NULL when a key is missing; concat_ws would skip it.
    joined = [parts[0]]
    for p in parts[1:]:
        joined += [F.lit("_"), p]
    return F.concat(*joined)


def lookup(keys: DataFrame, docs: DataFrame, spec: IndexSpec) -> DataFrame:
    """Documents by key fields: an equi-join on the id."""
    return keys.select(docid_of(keys, spec).alias("docid")).join(docs, "docid")


def docid_collisions(typed: DataFrame, spec: IndexSpec) -> DataFrame:
    """Ids that different keys share, such as ``a_b`` + ``c`` and ``a`` + ``b_c``."""
    key = F.struct(*[key_text(F.col("doc")[f.name], f).alias(f.name) for f in spec.keys])
    return (
        typed.filter(F.col("docid").isNotNull())
        .groupBy("docid")
        .agg(F.min(key).alias("a"), F.max(key).alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select("docid")
    )
