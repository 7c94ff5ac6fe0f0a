"""Typed read: raw documents to typed rows, one error text per rejected document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.coerce import Raw, cannot_fail, convert, key_text, let
from ..spec import JSON, STRINGS, Field, IndexSpec

KEY_MISSING = "a key field has no value"
NOT_AN_OBJECT = "document is not an object"


def _variant_path(name: str) -> str:
    quote = "'" if '"' in name else '"'
    return f"$[{quote}{name}{quote}]"


def _raw_columns(docs: DataFrame, spec: IndexSpec) -> tuple[DataFrame, dict[str, T.DataType]]:
    """Pull each declared field out of the payload as ``r0``, ``r1``, ...

    Only declared fields are looked at.  In a VARIANT an absent field is SQL NULL while
    a JSON null is a variant null, so the two stay apart.
    """
    kept = [c for c in docs.columns if c != "payload"]
    shape = docs.schema["payload"].dataType
    if isinstance(shape, T.VariantType):
        columns = [
            F.try_variant_get("payload", _variant_path(f.name), "variant").alias(f"r{i}")
            for i, f in enumerate(spec.fields)
        ]
        types: dict[str, T.DataType] = {f.name: T.VariantType() for f in spec.fields}
        not_object = (
            F.col("payload").isNull()
            | ~(F.is_variant_null("payload") | F.schema_of_variant("payload").startswith("OBJECT"))
        )
    else:
        types = {s.name: s.dataType for s in shape.fields if spec.get(s.name)}
        columns = [
            (F.col("payload").getField(f.name) if f.name in types else F.lit(None).cast("string")).alias(f"r{i}")
            for i, f in enumerate(spec.fields)
        ]
        types = {f.name: types.get(f.name, T.StringType()) for f in spec.fields}
        not_object = F.col("payload").isNull()
    failed = F.when(F.col("error").isNotNull(), F.lit("read")).when(not_object, F.lit("convert"))
    error = F.coalesce("error", F.when(not_object, F.lit(NOT_AN_OBJECT)))
    rows = docs.select(
        *[c for c in kept if c != "error"], *columns, error.alias("error"), failed.alias("stage")
    )
    return rows, types


def once(df: DataFrame, kept: list[str], columns: list[Column]) -> DataFrame:
    """Add ``columns``, computed once per row.

    A plain select would be merged with what follows, and each later use, such as the
    filter on ``error``, would repeat the conversion.  A one-element explode stands between.
    """
    return df.select(*kept, F.explode(F.array(F.struct(*columns))).alias("_")).select(*kept, "_.*")


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def typed_read(docs: DataFrame, spec: IndexSpec) -> DataFrame:
    """``(seq, payload, error)`` to ``(seq, docid, doc, error, stage)``.

    ``doc`` is a struct of the declared fields, NULL where absent.  ``stage`` tells
    whether a rejected document failed in the reader (``read``) or here (``convert``); it has
    no ``docid``, and its ``doc`` means nothing.
    One narrow pass: no shuffle, no Python.
    """
    rows, types = _raw_columns(docs, spec)
    kept = [c for c in docs.columns if c not in ("payload", "error")]
    at = range(len(spec.fields))
    raw_names = [f"r{i}" for i in at]
    variants = [i for i, f in enumerate(spec.fields) if isinstance(types[f.name], T.VariantType)]
    if variants:
        rows = once(
            rows,
            [*kept, "error", "stage", *[f"r{i}" for i in at if i not in variants]],
            [c for i in variants for c in (F.col(f"r{i}"), F.schema_of_variant(f"r{i}").alias(f"kind{i}"))],
        )
        # Reading a VARIANT is dear: each string is taken out once.
        rows = rows.select(
            "*",
            *[F.when(F.col(f"kind{i}") == "STRING", F.try_variant_get(f"r{i}", "$", "string")).alias(f"text{i}") for i in variants],
        )

    def seen(column) -> list[Raw]:
        return [
            Raw.of_variant(column(f"r{i}"), column(f"kind{i}"), column(f"text{i}"))
            if i in variants
            else Raw.of_column(column(f"r{i}"), types[f.name], spec.zone)
            for i, f in enumerate(spec.fields)
        ]

    def converted(raws: list[Raw]) -> list[Column]:
        return [convert(raw, f, spec.zone).alias(f"v{i}") for i, (raw, f) in enumerate(zip(raws, spec.fields))]

    raws = seen(F.col)
    fallible = [i for i, f in enumerate(spec.fields) if not cannot_fail(types[f.name], f)]
    carried = [*raw_names, *[f"{part}{i}" for i in variants for part in ("kind", "text")]]
    key_at = [i for i, f in enumerate(spec.fields) if f.pk]

    def why(raws: list[Raw], value) -> Column:
        """First conversion failure in field order, then the key test."""
        bad = [
            F.when(
                raws[i].present & value(f"v{i}").isNull(),
                F.concat(
                    F.lit(f"field {spec.fields[i].name}: can not convert "),
                    F.coalesce(raws[i].printed, F.lit("value")),
                    F.lit(f" to {spec.fields[i].type}"),
                ),
            )
            for i in fallible
        ]
        return F.coalesce(*bad, F.when(~_all([raws[i].present for i in key_at]), F.lit(KEY_MISSING)))

    value_names = [f"v{i}" for i in range(len(spec.fields))]

    def judged(r: Column) -> Column:
        raws = seen(lambda c: r[c])
        return let(
            F.struct(*converted(raws)),
            lambda v: F.struct(*[v[n].alias(n) for n in value_names], why(raws, lambda n: v[n]).alias("why")),
        )

    if fallible and not variants:
        values = once(rows, [*kept, "error", "stage", *raw_names], converted(raws))
        values = values.withColumn("why", why(raws, F.col))
    elif fallible:
        # In lambdas, so that many fields do not make one method too long to compile.
        row = F.transform(F.array(F.struct(*carried)), judged)
        values = rows.select(*kept, "error", "stage", F.explode(row).alias("_")).select(*kept, "error", "stage", "_.*")
    else:
        # Nothing to test: the plan stays open for pruning and pushdown down to the scan.
        values = rows.select(*kept, "error", "stage", *converted(raws), why(raws, F.col).alias("why"))
    # The id takes key values as converted, before any trimming.
    docid = F.concat_ws("_", *[key_text(F.col(f"v{i}"), spec.fields[i]) for i in key_at])
    doc = F.struct(*[_stored(F.col(f"v{i}"), f).alias(f.name) for i, f in enumerate(spec.fields)])
    checked = values.select(
        *kept,
        docid.alias("docid"),
        doc.alias("doc"),
        F.coalesce("error", "why").alias("error"),
        F.coalesce("stage", F.when(F.col("why").isNotNull(), F.lit("convert"))).alias("stage"),
    )
    ok = F.col("error").isNull()
    # A bare struct lets filters on fields and unused fields reach the scan.
    shown = F.when(ok, F.col("doc")).alias("doc") if fallible else F.col("doc")
    return checked.select(*kept, F.when(ok, F.col("docid")).alias("docid"), shown, "error", "stage")


def _stored(value: Column, field: Field) -> Column:
    """A field analysed by ``none`` is kept trimmed, string values of JSON fields too."""
    if field.tokenizer != text.NONE:
        return value
    if field.type in STRINGS:
        return text.trim_space(value)
    if field.type in JSON:
        trimmed = text.trim_space(F.try_variant_get(value, "$", "string")).cast("variant")
        return F.when(F.schema_of_variant(value) == "STRING", trimmed).otherwise(value)
    return value


def accepted(typed: DataFrame) -> DataFrame:
    return typed.filter(F.col("error").isNull()).drop("error", "stage")


def rejected(typed: DataFrame) -> DataFrame:
    return typed.filter(F.col("error").isNotNull()).drop("docid", "doc")
