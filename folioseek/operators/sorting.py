"""Sort keys over stored fields and relevance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import JSON, STRINGS, Field, IndexSpec, doc_field

# A pseudo field: sort by the relevance score itself.
RELEVANCE = "_score"


@dataclass(frozen=True)
class Sort:
    """``direction`` is descending unless it says ``asc``; ``as_text`` orders strings by text."""

    field: str
    direction: str = "desc"
    as_text: bool = False


def resolve(keys: Sequence[Sort], spec: IndexSpec) -> tuple[Sort, ...]:
    """Known keys only; the declared order when none is left."""
    known = tuple(k for k in keys if k.field == RELEVANCE or spec.get(k.field))
    return known or tuple(Sort(name, direction) for name, direction in spec.default_sort)


def stored_key(field: Field, as_text: bool) -> Column:
    """What the document alone contributes to a key, NULL if the field is missing.

    Strings sort by relevance unless ``as_text``: their part is a 0 that
    :func:`orderings` replaces by the whole-number score.
    """
    value = doc_field(field.name)
    if field.type in STRINGS:
        return value if as_text else F.when(value.isNotNull(), F.lit(0.0))
    if field.type in JSON:
        kind = F.schema_of_variant(value)
        number = F.when(kind.rlike(r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
        other = F.when(value.isNotNull() & ~F.is_variant_null(value), F.lit(0.0))
        # The flag says that this document takes its score as the key.
        return F.struct(F.coalesce(number, other).alias("number"), (kind == "STRING").alias("by_score"))
    return value


def doc_keys(keys: Sequence[Sort], spec: IndexSpec) -> list[Column]:
    """Columns ``k0``, ``k1``, ... to carry next to ``docid``; relevance needs none."""
    return [
        stored_key(spec.get(k.field), k.as_text).alias(f"k{i}")
        for i, k in enumerate(keys)
        if k.field != RELEVANCE
    ]


def uses_fields(keys: Sequence[Sort]) -> bool:
    return any(k.field != RELEVANCE for k in keys)


def orderings(keys: Sequence[Sort], spec: IndexSpec, score: Column) -> list[Column]:
    """Order columns, missing values last, ties broken by ``docid``."""
    out = []
    for i, k in enumerate(keys):
        if k.field == RELEVANCE:
            key = score
        else:
            field = spec.get(k.field)
            key = F.col(f"k{i}")
            if field.type in STRINGS and not k.as_text:
                key = F.when(key.isNotNull(), F.floor(score))
            elif field.type in JSON:
                key = F.when(key["by_score"], F.floor(score).cast("double")).otherwise(key["number"])
        out.append(key.asc_nulls_last() if k.direction == "asc" else key.desc_nulls_last())
    return [*out, F.col("docid").asc()]
