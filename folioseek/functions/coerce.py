"""Conversion of raw values to declared field types, as column expressions.

A raw value is either a VARIANT (JSON sources) or a typed column (CSV cells,
tables, literals in filters).  :class:`Raw` puts both behind one set of columns, and
only the branches a source can take end up in the plan.

Every converter gives NULL for a value it cannot convert; callers tell "absent" from
"not convertible" through ``Raw.present``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import BOOLS, FLOATS, SIGNED, STRINGS, UNSIGNED, Field

# Widths of the unsigned integers, the words read as true.
UNSIGNED_BITS = {"u8": 8, "u16": 16, "u32": 32}
TRUE_WORDS = ("yes", "y", "true")

# Guards: try_cast alone would accept surrounding blanks and type suffixes.
_SIGNED_TEXT = r"\A[+-]?[0-9]+\z"
_UNSIGNED_TEXT = r"\A[0-9]+\z"
_FLOAT_TEXT = r"(?i)\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z"
_SPECIAL_FLOAT = r"(?i)\A[+-]?(inf|infinity)\z|\Anan\z"
_NUMBER_KIND = r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)"



@dataclass(frozen=True)
class Raw:
    """One raw value seen as each of the kinds it may have; None = impossible kind."""

    present: Column
    null: Column | None = None
    text: Column | None = None
    is_text: Column | None = None
    whole: Column | None = None  # number cut to BIGINT
    exact: Column | None = None  # number as DECIMAL, for 64-bit unsigned
    real: Column | None = None  # number as DOUBLE
    is_number: Column | None = None
    flag: Column | None = None
    is_flag: Column | None = None
    instant: Column | None = None  # TIMESTAMP
    printed: Column | None = None  # any value as a string
    variant: Column | None = None

    @classmethod
    def of_variant(cls, v: Column, kind: Column | None = None, text: Column | None = None) -> Raw:
        """``kind`` and ``text`` may be given where they are columns already."""
        kind = F.schema_of_variant(v) if kind is None else kind
        return cls(
            present=v.isNotNull(),
            null=kind == "VOID",
            text=F.try_variant_get(v, "$", "string") if text is None else text,
            is_text=kind == "STRING",
            whole=F.try_variant_get(v, "$", "bigint"),
            exact=F.try_variant_get(v, "$", "decimal(38,9)"),
            real=F.try_variant_get(v, "$", "double"),
            is_number=kind.rlike(_NUMBER_KIND),
            flag=F.try_variant_get(v, "$", "boolean"),
            is_flag=kind == "BOOLEAN",
            printed=F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)),
            variant=v,
        )

    @classmethod
    def of_column(cls, c: Column, dtype: T.DataType, zone: str) -> Raw:
        """A typed column; SQL NULL means the field is absent."""
        yes = F.lit(True)
        present = c.isNotNull()
        if isinstance(dtype, T.VariantType):
            return cls.of_variant(c)
        if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
            return cls(present, text=c, is_text=yes, printed=c, variant=c.cast("variant"))
        if isinstance(dtype, T.BooleanType):
            return cls(present, flag=c, is_flag=yes, printed=c.cast("string"), variant=c.cast("variant"))
        if isinstance(dtype, T.NumericType):
            fractional = isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType)
            printed = c.cast("string")
            if fractional:
                printed = F.when(
                    (F.abs(c) < 1e15) & (F.floor(c.cast("double")) == c), c.try_cast("bigint").cast("string")
                ).otherwise(printed)
            return cls(
                present,
                whole=c.try_cast("bigint"),
                exact=c.try_cast("decimal(38,9)"),
                real=c.try_cast("double"),
                is_number=yes,
                printed=printed,
                variant=c.cast("variant"),
            )
        if isinstance(dtype, T.TimestampType):
            return cls(present, instant=c, printed=render_instant(c, "yyyy-MM-dd HH:mm:ss.SSSSSS", zone))
        if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
            wall = c.cast("timestamp_ntz")
            return cls(present, instant=wall_to_instant(wall, zone), printed=c.cast("string"))
        return cls(present, printed=F.to_json(c), variant=F.to_variant_object(c))

    def choose(self, *cases: tuple[Column | None, Column]) -> Column:
        """First case whose test holds; cases with an impossible test are left out."""
        live = [(test, value) for test, value in cases if test is not None]
        if not live:
            return F.lit(None)
        out = F.when(*live[0])
        for test, value in live[1:]:
            out = out.when(test, value)
        return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def epoch_wall() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def wall_to_instant(wall: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` -> instant, whatever the session zone is."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch_wall(), utc))


def micros_to_wall(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, epoch_wall())


def render_instant(instant: Column, fmt: str, zone: str) -> Column:
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), micros_to_wall(F.unix_micros(instant)))
    return F.date_format(wall, fmt)


def _nanos_to_micros(nanos: Column) -> Column:
    # Floor division: instants before the epoch must not round towards it.
    return F.floor(nanos.cast("decimal(20,0)") / F.lit(1000)).try_cast("bigint")


def to_string(raw: Raw) -> Column:
    return raw.choose((raw.null, F.lit("")), (raw.present, raw.printed))


def to_signed(raw: Raw, dtype: T.DataType) -> Column:
    number = raw.choose(
        (raw.null, F.lit(0).cast("bigint")),
        (
            raw.is_text,
            raw.text is not None
            and F.when(raw.text == "", F.lit(0).cast("bigint")).when(
                raw.text.rlike(_SIGNED_TEXT), raw.text.try_cast("bigint")
            ),
        ),
        (raw.is_number, raw.whole),
    )
    return number.try_cast(dtype)  # NULL beyond the type's range


def to_unsigned(raw: Raw, bits: int, dtype: T.DataType) -> Column:
    if bits <= 32:  # fits a BIGINT on the way
        zero = F.lit(0).cast("bigint")
        number = raw.choose(
            (raw.null, zero),
            (
                raw.is_text,
                raw.text is not None
                and F.when(raw.text == "", zero).when(raw.text.rlike(_UNSIGNED_TEXT), raw.text.try_cast("bigint")),
            ),
            (raw.is_number, raw.whole),
        )

        def bounded(n: Column) -> Column:
            return F.when((n >= 0) & (n < 1 << bits), n.try_cast(dtype))

        # A VARIANT is dear to read twice; a lambda would keep plain columns from compiling.
        return bounded(number) if raw.null is None else let(number, bounded)
    wide = "decimal(38,0)"
    number = raw.choose(
        (raw.null, F.lit(0).cast(wide)),
        (
            raw.is_text,
            raw.text is not None
            and F.when(raw.text == "", F.lit(0).cast(wide)).when(
                raw.text.rlike(_UNSIGNED_TEXT), raw.text.try_cast(wide)
            ),
        ),
        # Cut towards zero, as integer conversion does.
        (
            raw.is_number,
            raw.exact is not None
            and let(
                raw.exact,
                lambda n: F.when(n > -1, F.floor(F.greatest(n, F.lit(0).cast("decimal(38,9)"))).try_cast(wide)),
            ),
        ),
    )
    top = F.lit(str((1 << bits) - 1)).cast(wide)
    return let(number, lambda n: F.when(n <= top, n.try_cast(dtype)))


def to_float(raw: Raw, dtype: T.DataType) -> Column:
    parsed = raw.text.try_cast("double") if raw.text is not None else None
    number = raw.choose(
        (raw.null, F.lit(0.0)),
        (
            raw.is_text,
            parsed is not None
            and F.when(raw.text == "", F.lit(0.0))
            .when(raw.text.rlike(_SPECIAL_FLOAT), parsed)
            # A finite text must give a finite number.
            .when(raw.text.rlike(_FLOAT_TEXT) & (F.abs(parsed) < float("inf")), parsed),
        ),
        (raw.is_number, raw.real),
    )
    return number.cast(dtype)


def to_bool(raw: Raw) -> Column:
    return raw.choose(
        (raw.null, F.lit(False)),
        (raw.is_flag, raw.flag),
        (raw.is_number, raw.real is not None and (F.abs(raw.real) >= 1)),
        (
            raw.is_text,
            raw.text is not None
            and F.when(
                raw.text.rlike(_SIGNED_TEXT), F.coalesce(raw.text.try_cast("bigint") != 0, F.lit(False))
            ).otherwise(F.lower(raw.text).isin(*TRUE_WORDS)),
        ),
    )


def to_instant(raw: Raw, fmt: str, zone: str) -> Column:
    """Texts are read in ``zone``; a number counts nanoseconds since the epoch."""
    return raw.choose(
        (raw.null, F.timestamp_micros(F.lit(0).cast("bigint"))),
        (
            raw.is_text,
            # The zone is parsed along with the text, so the session zone plays no part.
            raw.text is not None
            and F.try_to_timestamp(F.concat(raw.text, F.lit(f" {zone}")), F.lit(f"{fmt} VV")),
        ),
        (raw.is_number, raw.whole is not None and F.timestamp_micros(_nanos_to_micros(raw.whole))),
        (None if raw.instant is None else raw.present, raw.instant),
    )


def to_day(raw: Raw, fmt: str, zone: str) -> Column:
    if raw.instant is None:
        return to_instant(raw, fmt, zone)
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), micros_to_wall(F.unix_micros(raw.instant)))
    return wall_to_instant(wall.cast("date").cast("timestamp_ntz"), zone)


def to_time_of_day(raw: Raw, fmt: str, zone: str) -> Column:
    """Nanoseconds since midnight."""
    clock = (
        F.try_to_timestamp(
            F.concat(F.lit("1970-01-01 "), raw.text, F.lit(" UTC")), F.lit(f"yyyy-MM-dd {fmt} VV")
        )
        if raw.text is not None
        else None
    )
    day = F.lit(86_400_000_000_000).cast("bigint")
    wall = (
        F.convert_timezone(F.lit("UTC"), F.lit(zone), micros_to_wall(F.unix_micros(raw.instant)))
        if raw.instant is not None
        else None
    )
    return raw.choose(
        (raw.null, F.lit(0).cast("bigint")),
        (raw.is_text, clock is not None and F.unix_micros(clock) * 1000),
        (raw.is_number, raw.whole),
        (
            None if wall is None else raw.present,
            wall is not None
            and F.pmod(F.timestamp_diff("MICROSECOND", epoch_wall(), wall) * 1000, day),
        ),
    )


def convert(raw: Raw, field: Field, zone: str) -> Column:
    """``raw`` as the declared type of ``field``; NULL if absent or not convertible."""
    kind = field.type
    if kind in STRINGS:
        return to_string(raw)
    if kind in SIGNED:
        return to_signed(raw, field.data_type)
    if kind in UNSIGNED:
        return to_unsigned(raw, UNSIGNED_BITS.get(kind, 64), field.data_type)
    if kind in FLOATS:
        return to_float(raw, field.data_type)
    if kind in BOOLS:
        return to_bool(raw)
    if kind == "date":
        return to_day(raw, field.time_fmt, zone)
    if kind == "datetime":
        return to_instant(raw, field.time_fmt, zone)
    if kind == "time":
        return to_time_of_day(raw, field.time_fmt, zone)
    return raw.variant


def cannot_fail(dtype: T.DataType, field: Field) -> bool:
    """Whether every non-NULL value of a column type converts to the declared type.

    Such fields need no test, so a scan that does not ask for them need not read them.
    """
    if field.type in STRINGS or field.type == "json":
        return not isinstance(dtype, T.VariantType) or field.type == "json"
    if isinstance(dtype, T.BooleanType):
        return field.type in BOOLS
    if isinstance(dtype, T.IntegralType):
        return field.type in FLOATS or field.type in BOOLS or field.data_type == T.LongType() and field.type in SIGNED
    if isinstance(dtype, T.NumericType):
        return field.type in FLOATS or field.type in BOOLS
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return field.type in ("date", "datetime", "time")
    return False


def render(value: Column, field: Field, zone: str) -> Column:
    """A stored value as it is shown: time types by their pattern, the rest as is."""
    if field.type in ("date", "datetime"):
        return render_instant(value, field.time_fmt, zone)
    if field.type == "time":
        return F.date_format(micros_to_wall(F.floor(value / 1000).cast("bigint")), field.time_fmt)
    return value


def key_text(value: Column, field: Field) -> Column:
    """A key value as part of a document id: instants as nanoseconds, floats plainly."""
    if field.type in ("date", "datetime"):
        return (F.unix_micros(value) * 1000).cast("string")
    if field.type in FLOATS:
        return Raw.of_column(value, field.data_type, "UTC").printed
    if field.type == "json":
        return Raw.of_variant(value).printed
    return value.cast("string")
