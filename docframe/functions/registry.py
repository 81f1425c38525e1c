"""Functions by name, and handlers for names that aren't known yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.errors import NotSupported
from docframe.functions import maths, nested, strings, temporal

_BUILT_IN: dict[str, Callable[..., Column]] = {
    "UNIXTIMESTAMP": lambda: F.unix_millis(F.current_timestamp()),
    "SHA_HASH": lambda s: F.sha1(s.cast("binary")),
    "TO_LOWER": strings.to_lower,
    "TO_UPPER": strings.to_upper,
    "DECIMAL_DIV": lambda a, b: F.try_divide(a.cast("decimal(28,10)"), b.cast("decimal(28,10)")),
    "DECIMAL_TEXT": lambda x: F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""),
    "REGEXP": lambda s, p: F.coalesce(F.rlike(s, p), F.lit(False)),
    "BASE64": lambda b: F.base64(b),
}
for _module in (strings, maths, temporal, nested):
    for _name, _f in vars(_module).items():
        if callable(_f) and not _name.startswith("_") and getattr(_f, "__module__", "") == _module.__name__:
            _BUILT_IN.setdefault(_name.upper(), _f)
_user: dict[str, Callable[..., Column]] = {}
_unknown: list[Callable[..., Column | None]] = []


def register(name: str, f: Callable[..., Column]) -> None:
    """Make ``f`` (columns to column) the function ``name``; it wins over a built-in one."""
    _user[name.upper()] = f


def unregister(name: str) -> None:
    _user.pop(name.upper(), None)


def on_unknown(handler: Callable[..., Column | None]) -> None:
    """Ask ``handler(name, *args)`` for names that aren't known; None passes on to the next."""
    _unknown.append(handler)


def call(name: str, *args) -> Column:
    f = _user.get(name.upper()) or _BUILT_IN.get(name.upper())
    if f:
        return f(*args)
    for handler in _unknown:
        if (out := handler(name, *args)) is not None:
            return out
    raise NotSupported(f"no function {name!r}")
