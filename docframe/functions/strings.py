"""String functions on columns. Lengths and positions count code points from 0; comparisons are by code point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def to_lower(s: Column) -> Column:
    return F.lower(s)


def to_upper(s: Column) -> Column:
    return F.upper(s)


def length(s: Column) -> Column:
    return F.char_length(s)


def contains(s: Column, part, ignore_case: bool = False) -> Column:
    return F.contains(F.lower(s), F.lower(_c(part))) if ignore_case else F.contains(s, _c(part))


def starts_with(s: Column, part, ignore_case: bool = False) -> Column:
    return F.startswith(F.lower(s), F.lower(_c(part))) if ignore_case else F.startswith(s, _c(part))


def ends_with(s: Column, part, ignore_case: bool = False) -> Column:
    """A suffix of the part's length is compared, so only an empty text ends with an empty part."""
    s, part = (F.lower(s), F.lower(_c(part))) if ignore_case else (s, _c(part))
    return F.endswith(s, part) & ((F.length(part) > 0) | (F.length(s) == 0))


def equals(a: Column, b, ignore_case: bool = False) -> Column:
    return F.lower(a) == F.lower(_c(b)) if ignore_case else a == _c(b)


def compare(a: Column, b, ignore_case: bool = False) -> Column:
    """-1, 0 or 1; 0 if either is null."""
    a, b = (F.lower(a), F.lower(_c(b))) if ignore_case else (a, _c(b))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def index_of(s: Column, part, ignore_case: bool = False) -> Column:
    """Position of the first occurrence, or -1."""
    s, part = (F.lower(s), F.lower(_c(part))) if ignore_case else (s, _c(part))
    return F.position(part, s) - 1


def substring(s: Column, start, count=None) -> Column:
    if count is None:
        return F.substring(s, _c(start) + 1, F.char_length(s))
    return F.substring(s, _c(start) + 1, _c(count))


def char_at(s: Column, i) -> Column:
    return F.substring(s, _c(i) + 1, F.lit(1))


def concat(*parts) -> Column:
    """All parts as text, a null one being empty."""
    return F.concat_ws("", *(_c(p).cast("string") for p in parts))


def format_string(template: str, *values) -> Column:
    """``{0}`` placeholders filled with values; null is empty."""
    import string

    pieces = []
    for text, name, *_ in string.Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name is not None:
            pieces.append(_c(values[int(name)]))
    return concat(*pieces)


def trim(s: Column) -> Column:
    """Without surrounding spaces; other white space stays."""
    return F.trim(s)


def trim_start(s: Column) -> Column:
    return F.ltrim(s)


def trim_end(s: Column) -> Column:
    return F.rtrim(s)


def replace(s: Column, old, new) -> Column:
    return F.replace(s, _c(old), _c(new))


def is_null_or_empty(s: Column) -> Column:
    return s.isNull() | (s == "")


def like(s: Column, pattern: str) -> Column:
    """SQL LIKE, without regard to case."""
    return F.ilike(s, F.lit(pattern))


def is_match(s: Column, pattern: str) -> Column:
    """Whether a regular expression matches somewhere; false for null."""
    return F.coalesce(F.rlike(s, F.lit(pattern)), F.lit(False))
