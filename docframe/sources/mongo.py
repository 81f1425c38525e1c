"""A façade with the names of a popular document database, over collections."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.errors import CastError
from docframe.plans.query import Query, column
from docframe.sources.database import Collection, Database


class Filter:
    """Conditions that are all to hold."""

    def __init__(self, *conditions: Column) -> None:
        self.conditions = conditions

    @staticmethod
    def empty() -> Filter:
        return Filter()

    @staticmethod
    def eq(field: Column | str, value: Any) -> Filter:
        return Filter(column(field).eqNullSafe(F.lit(value)))

    @staticmethod
    def gt(field: Column | str, value: Any) -> Filter:
        return Filter(column(field) > value)

    @staticmethod
    def lt(field: Column | str, value: Any) -> Filter:
        return Filter(column(field) < value)

    @staticmethod
    def in_(field: Column | str, values: Iterable[Any]) -> Filter:
        values = list(values)
        return Filter(column(field).isin(values) if values else F.lit(False))

    def __and__(self, other: Filter) -> Filter:
        return Filter(*self.conditions, *other.conditions)

    def build(self) -> Column:
        return reduce(lambda a, b: a & b, self.conditions, F.lit(True))


class QueryBuilder:
    EQ, GT, LT, IN = map(staticmethod, (Filter.eq, Filter.gt, Filter.lt, Filter.in_))


class BsonDocument:
    """One row's values by name, with checked and lenient conversions."""

    def __init__(self, row: Row | dict) -> None:
        self.values = row.asDict(recursive=True) if isinstance(row, Row) else dict(row)

    def __getitem__(self, name: str) -> BsonValue:
        return BsonValue(self.values[name])

    def get(self, name: str, default: Any = None) -> BsonValue:
        return BsonValue(self.values.get(name, default))

    def __contains__(self, name: str) -> bool:
        return name in self.values

    def __setitem__(self, name: str, value: Any) -> None:
        self.values[name] = value


class BsonValue:
    def __init__(self, value: Any) -> None:
        self.value = value

    is_null = property(lambda self: self.value is None)
    is_string = property(lambda self: isinstance(self.value, str))
    is_boolean = property(lambda self: isinstance(self.value, bool))
    is_int = property(lambda self: isinstance(self.value, int) and not self.is_boolean)
    is_double = property(lambda self: isinstance(self.value, float))
    is_array = property(lambda self: isinstance(self.value, list))
    is_document = property(lambda self: isinstance(self.value, dict))

    def _as(self, kind: type) -> Any:
        if not isinstance(self.value, kind) or (kind is int and self.is_boolean):
            raise CastError(f"{self.value!r} isn't {kind.__name__}")
        return self.value

    as_int = property(lambda self: self._as(int))
    as_double = property(lambda self: self._as(float))
    as_string = property(lambda self: self._as(str))
    as_boolean = property(lambda self: self._as(bool))
    as_array = property(lambda self: [BsonValue(v) for v in self._as(list)])
    as_document = property(lambda self: BsonDocument(self._as(dict)))

    def to_boolean(self) -> bool:
        return bool(self.value) and self.value != "false"

    def to_int(self) -> int:
        try:
            return int(float(self.value))
        except (TypeError, ValueError) as error:
            raise CastError(f"{self.value!r} isn't a number") from error

    def to_double(self) -> float:
        try:
            return float(self.value)
        except (TypeError, ValueError) as error:
            raise CastError(f"{self.value!r} isn't a number") from error


class MongoCollection:
    def __init__(self, inner: Collection) -> None:
        self.inner = inner

    def count_documents(self, filter: Filter) -> int:
        return self.find(filter).count()

    def find(self, filter: Filter = Filter()) -> Query:
        return self.inner.query().where(filter.build())

    def insert_one(self, item: dict) -> Any:
        return self.inner.insert(item)

    def insert_many(self, items: Iterable[dict]) -> list:
        return self.inner.insert_batch(items)

    def replace_one(self, filter: Filter, item: dict) -> int:
        return self.inner.replace_one(filter.build(), item)

    def replace_many(self, filter: Filter, item: dict) -> int:
        return self.inner.replace_many(filter.build(), item)

    def delete_one(self, filter: Filter) -> int:
        return self.inner.delete_one(filter.build())

    def delete_many(self, filter: Filter) -> int:
        return self.inner.delete_many(filter.build())


class MongoDatabase:
    def __init__(self, db: Database) -> None:
        self.db = db

    def get_collection(self, name: str, schema: T.StructType | None = None) -> MongoCollection:
        return MongoCollection(self.db.collection(name, schema))

    def list_collection_names(self) -> list[str]:
        return self.db.names()

    def drop_collection(self, name: str) -> bool:
        return self.db.drop(name, missing_ok=True)


class MongoClient:
    """A directory (or ``memory:``) of databases."""

    def __init__(self, spark: SparkSession, source: str) -> None:
        self.spark, self.source = spark, source
        self._open: dict[str, MongoDatabase] = {}

    def get_database(self, name: str) -> MongoDatabase:
        if name not in self._open:
            place = f"{self.source}{name}" if self.source.startswith("memory:") else f"{self.source.rstrip('/')}/{name}"
            self._open[name] = MongoDatabase(Database(self.spark, place))
        return self._open[name]
