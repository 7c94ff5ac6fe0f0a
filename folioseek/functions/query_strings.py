"""What users type as search strings, turned into the arguments of a search.

``q`` and ``fq`` are columns: a table of strings becomes a table of queries.  ``f``, ``s`` and ``fl``
describe one search and are read in place.  In all of them text between a pair of equal quotes is kept
together, delimiters included; a quote without a twin reaches to the end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filters import Filter
from ..operators.retrieve import CLAUSES, MUST, MUST_NOT, SHOULD
from ..operators.sorting import Sort
from .text import WHITE

_QUOTED = r"""'[^']*'?|"[^"]*"?|`[^`]*`?"""


def _pattern(delimiters: str) -> str:
    return rf"""(?:{_QUOTED}|[^{delimiters}'"`])+"""


def _pieces(column: Column, delimiters: str) -> Column:
    found = F.regexp_extract_all(column, F.lit(_pattern(delimiters)), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _signed(column: Column, field: Column) -> Column:
    """``+a b -c`` as clauses of one field (NULL: the whole document)."""

    def clause(piece: Column) -> Column:
        sign = F.substring(piece, 1, 1)
        occur = F.when(sign == "+", MUST).when(sign == "-", MUST_NOT).otherwise(SHOULD)
        text = F.when(sign.isin("+", "-"), piece.substr(F.lit(2), F.length(piece))).otherwise(piece)
        return F.struct(field.cast("string").alias("field"), text.alias("text"), occur.alias("occur"))

    return F.filter(F.transform(_pieces(column, WHITE), clause), lambda c: c["text"] != "")


def clauses(q: Column, fq: Column | None = None, strict: bool = False) -> Column:
    """Clauses of ``q`` (``+must -not "one token" should``) and ``fq`` (``field:q,field:q``; ``;`` separates too).

    A piece of ``fq`` without a field name says nothing; nor does one without words, but with ``strict`` that is an
    error which ends the job.
    """
    whole = _signed(q, F.lit(None))
    if fq is None:
        return whole.cast(CLAUSES)

    def in_field(piece: Column) -> Column:
        at = F.instr(piece, ":")
        found = _signed(piece.substr(at + 1, F.length(piece)), piece.substr(F.lit(1), at - 1))
        if not strict:
            return found
        empty = F.raise_error(F.concat(F.lit("no words in the field query "), piece)).cast(CLAUSES)
        return F.when(F.size(found) > 0, found.cast(CLAUSES)).otherwise(empty)

    named = F.filter(_pieces(fq, ",;"), lambda p: F.instr(p, ":") > 1)
    return F.concat(whole, F.flatten(F.transform(named, in_field))).cast(CLAUSES)


def filters(f: str) -> list[Filter]:
    """``age:10,12~15,20~;tags:"x"``: values and ranges of a field by commas, fields by semicolons."""
    out = []
    for part in re.findall(_pattern(";"), f or ""):
        name, colon, given = part.partition(":")
        items = re.findall(_pattern(","), given)
        ranges = [tuple(x.split("~", 1)) for x in items if "~" in x]
        values = [x for x in items if "~" not in x]
        if name and colon and items:
            out.append(Filter(name, values, ranges))
    return out


def sorts(s: str) -> list[Sort]:
    """``age:asc,update-time``: descending unless it says ``asc``."""
    words = [re.findall("[^: ]+", part) for part in re.split("[,;]", s or "")]
    return [Sort(w[0], "asc" if w[1:2] == ["asc"] else "desc") for w in words if w]


def fields(fl: str) -> list[str] | None:
    """``id,age,name``; None asks for all fields."""
    return re.findall("[^, ]+", fl or "") or None
