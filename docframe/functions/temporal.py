"""Date and time functions: members, constructors that give null for invalid parts, and .NET-style formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.errors import NotSupported

_MS = {"day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1_000}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


year, month, day, hour, minute, day_of_year = F.year, F.month, F.dayofmonth, F.hour, F.minute, F.dayofyear


def second(ts: Column) -> Column:
    return F.second(ts)


def millisecond(ts: Column) -> Column:
    return (F.unix_millis(ts.cast("timestamp")) % 1000).cast("int")


def day_of_week(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(ts) - 1


def day_number(d: Column) -> Column:
    """Days since 0001-01-01."""
    return F.datediff(d.cast("date"), F.to_date(F.lit("0001-01-01")))


def unix_milliseconds(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_unix_milliseconds(ms: Column) -> Column:
    return F.timestamp_millis(ms)


# Times of day and spans are milliseconds.


def time_of_day(ms: Column) -> dict[str, Column]:
    """hour, minute, second and millisecond of a time of day."""
    part = lambda unit, most: (F.call_function("div", ms, F.lit(unit)) % most).cast("int")
    return {"hour": part(3_600_000, 24), "minute": part(60_000, 60), "second": part(1000, 60), "millisecond": (ms % 1000).cast("int")}


def span_total(ms: Column, unit: str) -> Column:
    """A span in milliseconds, seconds, minutes, hours or days, as a real."""
    return ms.cast("double") if unit == "millisecond" else ms.cast("double") / _MS[unit]


def span_part(ms: Column, unit: str) -> Column:
    """Whole days, hours (0-23), minutes, seconds or milliseconds of a span, with its sign."""
    if unit == "millisecond":
        return (ms % 1000).cast("int")
    whole = F.call_function("div", ms, F.lit(_MS[unit]))
    most = {"day": None, "hour": 24, "minute": 60, "second": 60}[unit]
    return (whole if most is None else whole % most).cast("int")


def make_span(days=0, hours=0, minutes=0, seconds=0, milliseconds=0) -> Column:
    return (_c(days) * 86_400_000 + _c(hours) * 3_600_000 + _c(minutes) * 60_000 + _c(seconds) * 1000 + _c(milliseconds)).cast("long")


def span_from_ticks(ticks: Column) -> Column:
    return F.call_function("div", ticks, F.lit(10_000))


def make_time(hours, minutes, seconds=0, milliseconds=0) -> Column:
    """Milliseconds since midnight; null for invalid parts."""
    h, m, s, x = map(_c, (hours, minutes, seconds, milliseconds))
    good = h.between(0, 23) & m.between(0, 59) & s.between(0, 59) & x.between(0, 999)
    return F.when(good, make_span(0, h, m, s, x))


def make_date(y, m, d) -> Column:
    """Null for invalid parts, such as February 30th."""
    y, m, d = map(_c, (y, m, d))
    first = F.when(y.between(1, 9999) & m.between(1, 12), F.make_date(y, m, F.lit(1)))
    return F.when(first.isNotNull() & d.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, (d - 1).cast("int")))


def make_datetime(y, m, d, hours=0, minutes=0, seconds=0, milliseconds=0) -> Column:
    """A timestamp without zone; null for invalid parts."""
    date, time = make_date(y, m, d), make_time(hours, minutes, seconds, milliseconds)
    return (date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (time / 1000).cast("decimal(18,6)"))).cast("timestamp_ntz")


def datetime_of(date: Column, time_ms: Column) -> Column:
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (time_ms / 1000).cast("decimal(18,6)"))


def datetime_from_ticks(ticks: Column) -> Column:
    """100 ns ticks since 0001-01-01, truncated to microseconds."""
    return F.timestamp_micros(F.call_function("div", ticks, F.lit(10)) - 62_135_596_800_000_000).cast("timestamp_ntz")


def make_datetime_offset(local: Column, offset_minutes=0) -> Column:
    """The instant of a local time; null for offsets beyond 14 hours."""
    off = _c(offset_minutes)
    at = local.cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), off)
    return F.when(F.abs(off) <= 14 * 60, at)


STANDARD = {
    "d": "MM/dd/yyyy", "D": "dddd, dd MMMM yyyy", "f": "dddd, dd MMMM yyyy HH:mm", "F": "dddd, dd MMMM yyyy HH:mm:ss", "g": "MM/dd/yyyy HH:mm",
    "G": "MM/dd/yyyy HH:mm:ss", "m": "MMMM dd", "M": "MMMM dd", "y": "yyyy MMMM", "Y": "yyyy MMMM", "t": "HH:mm", "T": "HH:mm:ss",
    "s": "yyyy'-'MM'-'dd'T'HH':'mm':'ss", "u": "yyyy'-'MM'-'dd HH':'mm':'ss'Z'", "o": "yyyy'-'MM'-'dd'T'HH':'mm':'ss.fffffff",
    "O": "yyyy'-'MM'-'dd'T'HH':'mm':'ss.fffffff", "r": "ddd, dd MMM yyyy HH':'mm':'ss 'GMT'", "R": "ddd, dd MMM yyyy HH':'mm':'ss 'GMT'", "U": "dddd, dd MMMM yyyy HH:mm:ss",
}
_TOKEN = re.compile(r"'([^']*)'|\"([^\"]*)\"|\\(.)|%?(y+|M+|d+|H+|h+|m+|s+|f+|F+|t+|z+|g+|K)|(.)", re.S)
_DATE, _TIME = set("yMdg"), set("HhmsfFt")


def _token(token: str, ts: Column) -> Column:
    kind, n = token[0], len(token)
    simple = {
        "y": {1: "y", 2: "yy", 3: "yyy", 4: "yyyy", 5: "yyyyy"}, "M": {1: "M", 2: "MM", 3: "MMM", 4: "MMMM"}, "d": {1: "d", 2: "dd", 3: "EEE", 4: "EEEE"},
        "H": {1: "H", 2: "HH"}, "h": {1: "h", 2: "hh"}, "m": {1: "m", 2: "mm"}, "s": {1: "s", 2: "ss"},
    }
    if kind in simple:
        if token == "y":
            return (F.year(ts) % 100).cast("string")
        if kind == "y" and n > 2:
            return F.lpad(F.year(ts).cast("string"), n, "0")
        return F.date_format(ts, simple[kind][min(n, max(simple[kind]))])
    if kind in "fF":
        digits = F.substring(F.concat(F.lpad((F.unix_micros(ts.cast("timestamp")) % 1_000_000).cast("string"), 6, "0"), F.lit("0")), 1, n)
        return F.regexp_replace(digits, "0+$", "") if kind == "F" else digits
    if kind == "t":
        half = F.when(F.hour(ts) < 12, "AM").otherwise("PM")
        return half if n > 1 else F.substring(half, 1, 1)
    if kind == "g":
        return F.lit("A.D.")
    if kind == "K":
        return F.lit("")
    raise NotSupported(f"format token {token!r}: offsets aren't stored")


def format_time(value: Column, pattern: str = "G", kind: str = "datetime") -> Column:
    """``value`` by a standard specifier or custom pattern, invariant culture. ``kind`` is datetime, date or time (milliseconds);
    tokens of the other part are refused, as are zone tokens and patterns that aren't constant."""
    if not isinstance(pattern, str) or not pattern:
        raise NotSupported("the format must be a constant")
    pattern = STANDARD.get(pattern, pattern)
    ts = value if kind != "time" else F.timestamp_millis(value).cast("timestamp_ntz")
    pieces = []
    for m in _TOKEN.finditer(pattern):
        quoted, double, escaped, token, plain = m.groups()
        if token is None:
            pieces.append(F.lit(next(x for x in (quoted, double, escaped, plain) if x is not None)))
            continue
        if (kind == "date" and token[0] in _TIME) or (kind == "time" and token[0] in _DATE):
            raise NotSupported(f"format token {token!r} on a {kind} value")
        pieces.append(_token(token, ts))
    return F.when(value.isNotNull(), F.concat(*pieces))


def comparable(a: str, b: str) -> None:
    """Dates and times compare with their own type only."""
    if a != b:
        raise NotSupported(f"{a} and {b} don't compare")
