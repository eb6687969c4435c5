"""Functions of ids, intervals, rationals and money, and value formatters."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MINOR_DIGITS = {"EUR": 2, "USD": 2, "GBP": 2, "CHF": 2, "JPY": 0, "BTC": 8, "ETH": 18}


# Intervals: structs of lower and upper timestamps


def interval(lower: Column, upper: Column) -> Column:
    """An inclusive interval; null if it would end before it begins."""
    return F.when(lower <= upper, F.struct(lower.alias("lower"), upper.alias("upper")))


def lower(i: Column) -> Column:
    return i.getField("lower")


def upper(i: Column) -> Column:
    return i.getField("upper")


def width_micros(i: Column) -> Column:
    return F.unix_micros(upper(i)) - F.unix_micros(lower(i))


def midpoint(i: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(lower(i)) + F.floor(width_micros(i) / 2).cast("long"))


def overlaps(i: Column, start: Column, end: Column) -> Column:
    return (lower(i) <= end) & (upper(i) >= start)


# Ids: 32 hex digits


def is_id(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{32}$") & (c != "0" * 32)


def as_uuid(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def from_uuid(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "-", ""))


def timestamp_distance(now_ms: Column, id: Column) -> Column:
    """Milliseconds from a time-prefixed id's stamp (its first 32 bits) to ``now_ms``, around 2**32."""
    return F.pmod(now_ms - F.conv(id.substr(1, 8), 16, 10).cast("long"), F.lit(2**32))


# Money: decimals with 18 places; the currency is the attribute's, not the value's


def from_minor(c: Column, currency: str) -> Column:
    return (c.cast("decimal(38,18)") / F.lit(10 ** MINOR_DIGITS[currency])).cast("decimal(38,18)")


def to_minor(c: Column, currency: str) -> Column:
    """Minor units, or null if the amount is finer than one."""
    scaled = (c * F.lit(10 ** MINOR_DIGITS[currency])).cast("decimal(38,18)")
    return F.when(scaled == F.floor(scaled), scaled.cast("decimal(38,0)"))


# Rationals: structs of num and den


def rational(num: Column, den: Column) -> Column:
    """In lowest terms, the denominator positive; for parts within a long."""
    n, d = num.cast("long"), den.cast("long")
    # Euclid's algorithm: 92 steps are enough for any two longs.
    g = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.abs(n).alias("a"), F.abs(d).alias("b")), lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % s.b).alias("b")))).getField("a")
    sign = F.when(d < 0, -1).otherwise(1)
    return F.when(d != 0, F.struct(*((sign * F.call_function("div", k, g)).cast("decimal(38,0)").alias(name) for k, name in ((n, "num"), (d, "den")))))


def rational_less(x: Column, y: Column) -> Column:
    return x.getField("num") * y.getField("den") < y.getField("num") * x.getField("den")


RATIONAL = T.StructType([T.StructField(n, T.DecimalType(38, 0)) for n in ("num", "den")])


def _exactly(operation: Callable[[Fraction, Fraction], Fraction]) -> Callable[[Column, Column], Column]:
    """An operation of two rationals without rounding; null if either is, an error beyond 38 digits."""

    @F.pandas_udf(RATIONAL)
    def apply(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for a, b, c, d in zip(x["num"], x["den"], y["num"], y["den"], strict=True):
            if any(pd.isna(k) for k in (a, b, c, d)):
                rows.append((None, None))
            else:
                r = operation(Fraction(int(a), int(b)), Fraction(int(c), int(d)))
                rows.append((Decimal(r.numerator), Decimal(r.denominator)))
        return pd.DataFrame(rows, columns=["num", "den"])

    return lambda x, y: F.when(x.isNotNull() & y.isNotNull(), apply(x, y))


#: Exact arithmetic of amounts and rates as rationals: a rate applies without rounding.
plus, minus, times = (_exactly(o) for o in (Fraction.__add__, Fraction.__sub__, Fraction.__mul__))


def negated(x: Column) -> Column:
    return F.when(x.isNotNull(), F.struct((-x.getField("num")).cast("decimal(38,0)").alias("num"), x.getField("den").alias("den")))


# Formatters


_formatters: dict[str, Callable[[Column], Column]] = {
    "hash": lambda c: F.lower(F.hex(c)),
    "bytes": lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c))),
    "interval": lambda c: F.concat(lower(c).cast("string"), F.lit(".."), upper(c).cast("string")),
    "rational": lambda c: F.concat(c.getField("num").cast("string"), F.lit("/"), c.getField("den").cast("string")),
    "vector": lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.format_number(x, 3)), " "), F.lit("]")),
}


def register_formatter(encoding: str, formatter: Callable[[Column], Column]) -> None:
    _formatters[encoding] = formatter


def formatted(c: Column, encoding: str) -> Column:
    return _formatters.get(encoding, lambda x: x.cast("string"))(c)
