"""Document value types and the Spark types that hold them."""

from __future__ import annotations

from pyspark.sql import types as T

from docframe.errors import NotSupported

_PLAIN = {
    "bool": T.BooleanType(),
    "char": T.StringType(),
    "int8": T.ByteType(),
    "uint8": T.ShortType(),
    "int16": T.ShortType(),
    "uint16": T.IntegerType(),
    "int32": T.IntegerType(),
    "uint32": T.LongType(),
    "int64": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "bigint": T.DecimalType(38, 0),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "decimal": T.DecimalType(38, 18),
    "datetime": T.TimestampNTZType(),
    "datetimeoffset": T.TimestampType(),
    "dateonly": T.DateType(),
    "timeonly": T.LongType(),
    "timespan": T.LongType(),
    "guid": T.StringType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
    "enum": T.IntegerType(),
    "type": T.StringType(),
    "ref": T.LongType(),
    "json": T.VariantType(),
}


def spark_type(kind: object) -> T.DataType:
    """The Spark type of a value type: a name (``int64``, ``string?``), ``[item]`` for a list, ``{"map": value}``, ``{"field":
    type, ...}`` for an object, a tuple for a tuple, or a Spark type as it is. Optional (``?``) types are the same type, as every
    column may be null. Times of day and spans are milliseconds."""
    if isinstance(kind, T.DataType):
        return kind
    if isinstance(kind, str):
        name = kind.rstrip("?").lower()
        if name in _PLAIN:
            return _PLAIN[name]
        raise NotSupported(f"no value type {kind!r}")
    if isinstance(kind, list) and len(kind) == 1:
        return T.ArrayType(spark_type(kind[0]))
    if isinstance(kind, tuple):
        return T.StructType([T.StructField(f"Item{i}", spark_type(k)) for i, k in enumerate(kind, 1)])
    if isinstance(kind, dict):
        if set(kind) == {"map"}:
            return T.MapType(T.StringType(), spark_type(kind["map"]))
        return T.StructType([T.StructField(n, spark_type(k)) for n, k in kind.items()])
    raise NotSupported(f"no value type {kind!r}")


def schema(fields: dict[str, object], id_field: str | None = "Id") -> T.StructType:
    """A collection's schema: its 64-bit id first, then the fields."""
    out = [T.StructField(id_field, T.LongType(), False)] if id_field and id_field not in fields else []
    return T.StructType(out + [T.StructField(n, spark_type(k)) for n, k in fields.items()])


def polymorphic(base: dict[str, object], *kinds: dict[str, object]) -> T.StructType:
    """The schema that holds several document types: a ``_type`` name and the union of all fields."""
    fields = {"_type": "string"} | base
    for kind in kinds:
        fields |= kind
    return schema(fields)
