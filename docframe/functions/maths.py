"""Arithmetic and math functions. What has no result (division by zero, a root of a negative) is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _real(x: Column) -> Column:
    return x.cast("double")


sin, cos, tan, atan, atan2 = F.sin, F.cos, F.tan, F.atan, F.atan2
sinh, cosh, tanh, asinh = F.sinh, F.cosh, F.tanh, F.asinh
exp, sign = F.exp, F.signum


def _within(x: Column, inside: Column, out: Column) -> Column:
    return F.when(inside, out)


def asin(x: Column) -> Column:
    return _within(x, F.abs(x) <= 1, F.asin(x))


def acos(x: Column) -> Column:
    return _within(x, F.abs(x) <= 1, F.acos(x))


def acosh(x: Column) -> Column:
    return _within(x, x >= 1, F.acosh(x))


def atanh(x: Column) -> Column:
    return _within(x, F.abs(x) < 1, F.atanh(x))


def log(x: Column) -> Column:
    return F.ln(x)


def log2(x: Column) -> Column:
    return F.log2(x)


def log10(x: Column) -> Column:
    return F.log10(x)


def power(x: Column, y) -> Column:
    return F.pow(x, _c(y))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def ceiling(x: Column) -> Column:
    return _real(F.ceil(x))


def floor(x: Column) -> Column:
    return _real(F.floor(x))


def truncate(x: Column) -> Column:
    return _real(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)))


def round_half_away(x: Column, digits: int = 0) -> Column:
    """Halves go away from zero."""
    return F.round(x, digits)


def absolute(x: Column) -> Column:
    return F.abs(x)


def smaller(a: Column, b) -> Column:
    """The smaller of two; null if either is."""
    b = _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def larger(a: Column, b) -> Column:
    b = _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def ieee_remainder(x: Column, y) -> Column:
    y = _c(y)
    return F.when(y != 0, x - y * F.round(x / F.nullif(y, F.lit(0).cast("double"))))


def big_mul(x: Column, y) -> Column:
    return x.cast("long") * _c(y).cast("long")


def divide(x: Column, y) -> Column:
    """Real division; null by zero."""
    return F.try_divide(_real(x), _real(_c(y)))


def int_divide(x: Column, y) -> Column:
    """Whole division toward zero; null by zero."""
    y = _c(y)
    return F.call_function("div", x, F.when(y != 0, y))


def modulo(x: Column, y) -> Column:
    """Remainder with the sign of ``x``; null by zero."""
    y = _c(y)
    return x % F.when(y != 0, y)


def negate(x: Column) -> Column:
    return -x


def to_int(x: Column, kind: str = "long") -> Column:
    """Toward zero; null where text isn't a number or the number doesn't fit."""
    return x.try_cast("double").try_cast(kind)


def to_real(x: Column) -> Column:
    return x.try_cast("double")


#: Parsers by target type; all give null for what isn't a number, and ignore surrounding spaces.
PARSERS = {
    name: kind
    for name, kind in (
        ("int8", "tinyint"), ("uint8", "smallint"), ("int16", "smallint"), ("uint16", "int"), ("int32", "int"), ("uint32", "bigint"),
        ("int64", "bigint"), ("uint64", "decimal(20,0)"), ("float32", "float"), ("float64", "double"), ("decimal", "decimal(38,18)"), ("bigint", "decimal(38,0)"),
    )
}


def parse(s: Column, kind: str = "int64") -> Column:
    return F.trim(s).try_cast(PARSERS[kind])


def exact_average(x: Column, group: bool = True) -> Column:
    """Aggregate: the average in decimal arithmetic."""
    return F.avg(x.cast("decimal(28,10)"))
