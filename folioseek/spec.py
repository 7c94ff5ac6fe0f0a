"""The declared shape of an index: field names, types, analysers, keys, sort."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text

# Declared type -> column type.
SIGNED = {
    "i8": T.ByteType(),
    "i16": T.ShortType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "int": T.LongType(),
    "integer": T.LongType(),
    "timestamp": T.LongType(),
}
UNSIGNED = {
    "u8": T.ShortType(),
    "u16": T.IntegerType(),
    "u32": T.LongType(),
    "u64": T.DecimalType(20, 0),
    "uint": T.DecimalType(20, 0),
}
FLOATS = {"f32": T.FloatType(), "f64": T.DoubleType(), "float": T.DoubleType()}
STRINGS = {"str": T.StringType(), "string": T.StringType()}
BOOLS = {"bool": T.BooleanType(), "boolean": T.BooleanType()}
TIMES = {"date": T.TimestampType(), "datetime": T.TimestampType(), "time": T.LongType()}
JSON = {"json": T.VariantType()}
COLUMN_TYPES = {**STRINGS, **SIGNED, **UNSIGNED, **FLOATS, **BOOLS, **TIMES, **JSON}

# Default patterns of the time types, default zone (UTC+8).
TIME_FORMATS = {"date": "yyyy-MM-dd", "time": "HH:mm:ss", "datetime": "yyyy-MM-dd HH:mm:ss"}
DEFAULT_ZONE = "+08:00"
# The words of a layout, which spells out one moment, and their patterns.
LAYOUT_WORDS = {
    "January": "MMMM", "Jan": "MMM", "Monday": "EEEE", "Mon": "EEE", "2006": "yyyy", "-07:00": "xxx", "-0700": "xx", "Z07:00": "XXX",
    "MST": "z", "PM": "a", "06": "yy", "01": "MM", "02": "dd", "15": "HH", "03": "hh", "04": "mm", "05": "ss", "1": "M", "2": "d",
    "3": "h", "4": "m", "5": "s",
}
_LAYOUT = re.compile("|".join(map(re.escape, LAYOUT_WORDS)) + r"|(?<=05)[.,][09]+|[A-Za-z']+|.", re.S)


def layout_pattern(layout: str) -> str:
    """A time layout such as ``2006-01-02 15:04:05`` as a date pattern; a text without digits is a pattern already."""
    if not re.search("[0-9]", layout):
        return layout

    def word(m: re.Match) -> str:
        w = m.group()
        if w in LAYOUT_WORDS:
            return LAYOUT_WORDS[w]
        if len(w) > 1 and w[0] in ".,":
            return w[0] + "S" * (len(w) - 1)
        if w[0].isdigit():
            raise ValueError(f"time layout {layout}: {w} is no part of the reference moment")
        return "'" + w.replace("'", "''") + "'" if w[0].isalpha() or w[0] == "'" else w

    return _LAYOUT.sub(word, layout)


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "str"
    pk: bool = False
    tokenizer: str = text.SPACE
    sorting: str | None = None
    time_fmt: str | None = None

    @property
    def data_type(self) -> T.DataType:
        return COLUMN_TYPES[self.type]

    @property
    def has_text(self) -> bool:
        """Whether values of this field can yield tokens."""
        return (self.type in STRINGS or self.type in JSON) and self.tokenizer != text.NONE


@dataclass(frozen=True)
class IndexSpec:
    """A checked field list.  Build it with :meth:`of` or :meth:`from_dict`."""

    name: str
    fields: tuple[Field, ...]
    zone: str = DEFAULT_ZONE

    @classmethod
    def of(cls, name: str, fields: Iterable[Field], zone: str = DEFAULT_ZONE) -> IndexSpec:
        checked: list[Field] = []
        for i, f in enumerate(fields):
            if not f.name:
                raise ValueError(f"{name}: field #{i} has no name")
            if any(g.name == f.name for g in checked):
                raise ValueError(f"{name}: field {f.name} is declared twice")
            if f.type not in COLUMN_TYPES:
                raise ValueError(f"{name}: field {f.name} has unknown type {f.type}")
            if f.tokenizer not in text.TOKENIZERS:
                raise ValueError(f"{name}: field {f.name} has unknown tokenizer {f.tokenizer}")
            if f.type in TIMES and not f.time_fmt:
                f = replace(f, time_fmt=TIME_FORMATS[f.type])
            checked.append(f)
        if not checked:
            raise ValueError(f"{name}: no fields declared")
        if not any(f.pk for f in checked):
            raise ValueError(f"{name}: no primary-key field declared")
        return cls(name, tuple(checked), zone)

    @classmethod
    def from_dict(cls, name: str, conf: Mapping, zone: str = DEFAULT_ZONE) -> IndexSpec:
        """From the JSON form ``{"fields": [{"name": ..., "type": ..., "pk": ...}]}``.

        ``time-fmt`` may be a layout (``2006-01-02``) or a pattern (``yyyy-MM-dd``).
        """
        return cls.of(
            name,
            (
                Field(
                    name=f.get("name", ""),
                    type=f.get("type") or "str",
                    pk=bool(f.get("pk", False)),
                    tokenizer=f.get("tokenizer") or text.SPACE,
                    sorting=f.get("sorting"),
                    time_fmt=layout_pattern(f["time-fmt"]) if f.get("time-fmt") else None,
                )
                for f in conf.get("fields") or ()
            ),
            zone,
        )

    def get(self, name: str | None) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def keys(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.pk)

    @property
    def default_sort(self) -> tuple[tuple[str, str], ...]:
        """Declared ``sorting`` keys, else the primary key ascending."""
        declared = tuple(
            (f.name, f.sorting) for f in self.fields if f.sorting in ("asc", "desc")
        )
        return declared or tuple((f.name, "asc") for f in self.keys)

    def struct_type(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField(
                    f.name,
                    f.data_type,
                    True,
                    {
                        "type": f.type,
                        "pk": f.pk,
                        "tokenizer": f.tokenizer,
                        "sorting": f.sorting or "",
                        "time_fmt": f.time_fmt or "",
                    },
                )
                for f in self.fields
            ]
        )


def doc_field(name: str, doc: str = "doc") -> Column:
    """Column of one field inside the document struct."""
    return F.col(doc)[name]
