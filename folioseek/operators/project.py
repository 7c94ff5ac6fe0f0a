"""Output fields and sparse JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.coerce import render
from ..spec import Field, IndexSpec, doc_field


def output_fields(fields: Sequence[str] | None, spec: IndexSpec) -> tuple[Field, ...]:
    """The chosen fields in the given order, all when none are chosen; unknown ones fail."""
    if not fields:
        return spec.fields
    chosen = []
    for name in fields:
        field = spec.get(name)
        if field is None:
            raise ValueError(f"no field {name} to show")
        chosen.append(field)
    return tuple(chosen)


def output_columns(fields: Sequence[str] | None, spec: IndexSpec) -> list[Column]:
    """Shown values, time types in their pattern and the index's zone."""
    return [render(doc_field(f.name), f, spec.zone).alias(f.name) for f in output_fields(fields, spec)]


def json_document(fields: Sequence[str] | None, spec: IndexSpec) -> Column:
    """The document as JSON text; absent fields are left out."""
    return F.to_json(F.struct(*output_columns(fields, spec)))
