"""Filters on stored fields, built as predicates that the scan can push down."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.coerce import Raw, convert
from ..spec import BOOLS, JSON, STRINGS, Field, IndexSpec, doc_field


@dataclass(frozen=True)
class Filter:
    """``values`` are alternatives, ``ranges`` (low, high) are alternatives, ends included.

    A None or ``""`` end leaves a range open.
    """

    field: str
    values: Sequence[Any] = ()
    ranges: Sequence[tuple[Any, Any]] = ()


def _any(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def _all(cols: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)


def _literal_type(value: Any) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, datetime):
        return T.TimestampNTZType() if value.tzinfo is None else T.TimestampType()
    if isinstance(value, date):
        return T.DateType()
    return T.StringType()


def _operand(value: Any, field: Field, zone: str) -> Column:
    """The operand in the field's type, NULL if it does not convert.

    All of it is foldable, so the optimizer sees a plain literal.
    """
    dtype = _literal_type(value)
    lit = F.lit(value).cast(dtype)
    if field.type in JSON:
        return lit.cast("string") if isinstance(dtype, T.StringType) else lit.cast("double")
    return convert(Raw.of_column(lit, dtype, zone), field, zone)


def _json_string(stored: Column) -> Column:
    return F.when(F.schema_of_variant(stored) == "STRING", F.try_variant_get(stored, "$", "string"))


def _text_equals(stored: Column, operand: Column, field: Field) -> Column:
    if field.tokenizer == text.HAN:
        return F.contains(stored, operand)
    if field.tokenizer == text.NONE:
        return stored == operand
    return text.has_token(stored, operand)


def _equals(stored: Column, operand: Column, value: Any, field: Field) -> Column:
    if field.type in STRINGS:
        return _text_equals(stored, operand, field)
    if field.type in JSON:
        if isinstance(value, str):
            return _text_equals(_json_string(stored), operand, field)
        return F.try_variant_get(stored, "$", "double") == operand
    return stored == operand


def _field_predicate(f: Filter, field: Field, zone: str, combine: str) -> Column | None:
    stored = doc_field(field.name)
    # (operand converts?, predicate) pairs; operands that do not convert drop out.
    values = [(op.isNotNull(), _equals(stored, op, v, field)) for v in f.values for op in [_operand(v, field, zone)]]
    ranges = []
    for low, high in f.ranges:
        ends = [(e, sign) for e, sign in ((low, ">="), (high, "<=")) if e is not None and e != ""]
        if not ends:
            continue
        ops = [(_operand(e, field, zone), sign) for e, sign in ends]
        usable = _all(op.isNotNull() for op, _ in ops)
        if field.type in BOOLS:
            inside = F.lit(False)
        else:
            side = _json_string(stored) if field.type in JSON else stored
            inside = _all((side >= op) if sign == ">=" else (side <= op) for op, sign in ops)
        ranges.append((usable, inside))
    groups = [g for g in (values, ranges) if g]
    if not groups:
        return None
    live = [_any(u for u, _ in g) for g in groups]
    hit = [_any(u & p for u, p in g) for g in groups]
    # A NULL comparison counts as no match, so nothing hides the comparisons from the scan.
    if combine == "or":
        return ~_any(live) | (stored.isNotNull() & _any(hit))
    return ~_any(live) | (stored.isNotNull() & _all(~u | h for u, h in zip(live, hit)))


def predicate(filters: Sequence[Filter], spec: IndexSpec, combine: str = "and") -> Column | None:
    """One predicate over ``doc``; None when no filter is left.

    Within a field the value group and the range group must both hold (``combine="or"``
    makes either enough); fields must all hold.  A document without the field does not
    match.  Operands that do not convert are dropped, and so are filters left empty or
    naming an unknown field.
    """
    if combine not in ("and", "or"):
        raise ValueError(f"combine must be and or or, not {combine}")
    parts = []
    for f in filters:
        field = spec.get(f.field)
        p = _field_predicate(f, field, spec.zone, combine) if field else None
        if p is not None:
            parts.append(p)
    return _all(parts) if parts else None
