"""Arrays, maps, objects and schemaless (variant) values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.errors import NotSupported, RangeError


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def count(a: Column) -> Column:
    return F.size(a)


def byte_length(b: Column) -> Column:
    return F.octet_length(b)


def item(a: Column, i: int) -> Column:
    """The i-th item from 0; null outside. The position has to be constant."""
    if not isinstance(i, int):
        raise NotSupported("an array index must be a constant")
    return F.get(a, F.lit(i)) if i >= 0 else F.lit(None)


def any_item(a: Column, p=None) -> Column:
    return F.exists(a, p) if p else F.size(a) > 0


def all_items(a: Column, p) -> Column:
    return F.forall(a, p)


def contains_item(a: Column, value) -> Column:
    """Whether an item equals the value, null matching null."""
    v = _c(value)
    return F.exists(a, lambda x: x.eqNullSafe(v))


def in_list(x: Column, values: list) -> Column:
    return x.isin(values) if values else F.lit(False)


def map_value(m: Column, key) -> Column:
    return F.try_element_at(m, _c(key))


def equals_object(o: Column, value: dict | list) -> Column:
    """Structural equality with a constant: every path null-safe, arrays with their length."""
    if isinstance(value, dict):
        return reduce(lambda a, b: a & b, (equals_object(o[k], v) for k, v in value.items()), F.lit(True))
    if isinstance(value, list):
        return reduce(lambda a, b: a & b, (equals_object(F.get(o, F.lit(i)), v) for i, v in enumerate(value)), F.coalesce(F.size(o) == len(value), F.lit(False)))
    return o.eqNullSafe(F.lit(value))


# Edits of arrays and objects, as update transforms use them.


def append(a: Column, value) -> Column:
    return F.array_append(a, _c(value))


def set_at(a: Column, i: int, value) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, _c(value)).otherwise(x))


def remove_at(a: Column, i: int) -> Column:
    return F.filter(a, lambda x, k: k != i)


def insert_at(a: Column, i: int, value) -> Column:
    """Shifts later items; a position beyond the end appends."""
    if i < 0:
        raise RangeError("a negative position")
    head = F.slice(a, F.lit(1), F.lit(i)) if i else F.slice(a, F.lit(1), F.lit(0))
    return F.concat(head, F.array(_c(value)), F.slice(a, F.lit(i + 1), F.greatest(F.size(a), F.lit(1))))


def set_field(o: Column, path: str, value) -> Column:
    return o.withField(path, _c(value))


def remove_field(o: Column, *paths: str) -> Column:
    return o.dropFields(*paths)


# Group operations on arrays of projected values: null-safe and without repeats.


def union(a: Column, b) -> Column:
    return F.array_union(a, _c(b))


def intersect(a: Column, b) -> Column:
    return F.array_intersect(a, _c(b))


def except_(a: Column, b) -> Column:
    return F.array_except(a, _c(b))


def distinct_items(a: Column) -> Column:
    return F.array_distinct(a)


# Schemaless documents.


def parse_json(s: Column) -> Column:
    """A variant, or null for what isn't JSON."""
    return F.try_parse_json(s)


def print_json(v: Column) -> Column:
    return F.to_json(v)


def dyn(v: Column, path: str, kind: str = "string") -> Column:
    """The value at ``path`` (a name, ``a.b`` or ``$...``) of a variant as ``kind``; null if missing or of another type."""
    return F.try_variant_get(v, path if path.startswith("$") else f"$.{path}", kind)


def json_value(s: Column, path: str) -> Column:
    """Text at a JSON path of a JSON string."""
    return F.get_json_object(s, path)


def json_kind(v: Column) -> Column:
    """null, boolean, number, string, array or object."""
    name = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None)
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .otherwise("number")
    )


def object_of(**fields) -> Column:
    return F.struct(*(_c(v).alias(k) for k, v in fields.items()))


def array_of(*items) -> Column:
    return F.array(*map(_c, items))
