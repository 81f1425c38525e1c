"""Fluent, lazily evaluated queries over a DataFrame.

A query is immutable: each operator returns a new one. Besides the DataFrame it carries the pending order, because Spark keeps
none: the order is applied where it matters (paging, element access, the result). Operators that answer with a value
run the query; the same answers as one-row DataFrames come from ``aggregate``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from docframe.errors import CardinalityError, CastError, InvalidOperation, NotSupported, RangeError
from docframe.operators import ordering, sets

_NONE = object()


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Query:
    frame: DataFrame
    keys: tuple[ordering.Key, ...] = ()
    id: str | None = None
    kind: str = "_type"

    # -- results

    @property
    def df(self) -> DataFrame:
        """The rows, in order if one is pending."""
        return self.frame.orderBy(*ordering.sort_columns(self.keys)) if self.keys else self.frame

    def to_list(self) -> list[Row]:
        return self.df.collect()

    def explain(self) -> str:
        """The physical plan as text."""
        return self.df._jdf.queryExecution().explainString(self.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _with(self, frame: DataFrame, **changes) -> Query:
        return replace(self, frame=frame, **changes)

    def total_order(self) -> list[ordering.Key]:
        """The pending order with the id as the last key."""
        if self.id is None and not self.keys:
            raise InvalidOperation("the query has neither an order nor an id")
        return [*self.keys, *([(F.col(self.id), False)] if self.id in self.frame.columns else [])]

    # -- rows and columns

    def where(self, condition: Column | str) -> Query:
        return self._with(self.frame.where(condition))

    def select(self, *columns: Column | str, **named: Column | str) -> Query:
        """A projection. The pending order is kept only if its columns are."""
        picked = [column(c) for c in columns] + [column(c).alias(n) for n, c in named.items()]
        out = self.frame.select(*picked)
        if self.keys:
            hidden = self.frame.select(*picked, *(c.alias(f"__o{i}") for i, (c, _) in enumerate(self.keys)))
            return Projected(hidden, tuple((F.col(f"__o{i}"), d) for i, (_, d) in enumerate(self.keys)), self.id, self.kind, tuple(out.columns))
        return self._with(out)

    def with_column(self, name: str, value: Column) -> Query:
        return self._with(self.frame.withColumn(name, value))

    def of_type(self, name: str) -> Query:
        """Documents of one type, by their discriminator."""
        self._typed()
        return self.where(F.col(self.kind) == name)

    def is_type(self, name: str) -> Column:
        """Whether a document is of a type; false for none."""
        self._typed()
        return F.coalesce(F.col(self.kind) == name, F.lit(False))

    def cast(self, name: str) -> Query:
        """All documents as one type; the result fails with CastError's text where one has another."""
        self._typed()
        bad = F.raise_error(F.concat(F.lit(f"{CastError.__name__}: not a {name}: "), F.coalesce(F.col(self.kind), F.lit("null"))))
        return self.where(F.when(F.col(self.kind) == name, True).otherwise(bad.cast("boolean")))

    def _typed(self) -> None:
        if self.kind not in self.frame.columns:
            raise NotSupported("the documents carry no type")

    def select_many(self, array: Column | str, alias: str = "value", position: str | None = None) -> Query:
        """One row for each item of an array; none for a null or empty one. Bytes aren't a sequence."""
        kind = self.frame.select(column(array)).schema[0].dataType.typeName()
        if kind == "binary":
            raise NotSupported("bytes aren't un-nested")
        if position:
            return self._with(self.frame.select("*", F.posexplode(column(array)).alias(position, alias)))
        return self._with(self.frame.select("*", F.explode(column(array)).alias(alias)))

    # -- order and paging

    def order_by(self, *keys: Column | str) -> Query:
        return self._with(self.frame, keys=tuple((column(k), False) for k in keys))

    def order_by_descending(self, *keys: Column | str) -> Query:
        return self._with(self.frame, keys=tuple((column(k), True) for k in keys))

    def then_by(self, *keys: Column | str) -> Query:
        return self._then(keys, False)

    def then_by_descending(self, *keys: Column | str) -> Query:
        return self._then(keys, True)

    def _then(self, keys: Sequence, down: bool) -> Query:
        if not self.keys:
            raise InvalidOperation("then_by needs an order")
        return self._with(self.frame, keys=(*self.keys, *((column(k), down) for k in keys)))

    def order(self, descending: bool = False) -> Query:
        """By the rows themselves, column by column."""
        return self._with(self.frame, keys=tuple((F.col(c), descending) for c in self.frame.columns))

    def take(self, n: int) -> Query:
        return self._with(self.df.limit(n))

    def skip(self, n: int) -> Query:
        return self._with(self.df.offset(n))

    def take_while(self, p: Column) -> Query:
        self._ordered("take_while")
        return self._with(ordering.take_while(self.frame, self.total_order(), p))

    def skip_while(self, p: Column) -> Query:
        self._ordered("skip_while")
        return self._with(ordering.skip_while(self.frame, self.total_order(), p))

    def _ordered(self, what: str) -> None:
        if not self.keys:
            raise InvalidOperation(f"{what} needs an order")

    def last(self, n: int = 1) -> Query:
        """The last rows; without an order, by id."""
        keys = tuple(ordering.reverse(self.total_order()))
        return self._with(self.frame.orderBy(*ordering.sort_columns(keys)).limit(n))

    def element_at(self, i: int) -> Query:
        if i < 0:
            raise RangeError("a negative position")
        return self._with((self.df.offset(i) if i else self.df).limit(1))

    def default_if_empty(self, **values: Any) -> Query:
        """One row of ``values`` (else nulls) if there is no row."""
        spark, schema = self.frame.sparkSession, self.frame.schema
        row = spark.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema))
        seen = self.frame.limit(1).select(F.lit(True)).scalar()
        return self._with(self.frame.unionByName(row.where(seen.isNull())))

    # -- elements, which run the query

    def _pick(self, n: int, p: Column | None) -> list[Row]:
        q = self if p is None else self.where(p)
        return q.df.limit(n).collect()

    def first(self, p: Column | None = None) -> Row:
        rows = self._pick(1, p)
        if not rows:
            raise CardinalityError("the sequence contains no elements")
        return rows[0]

    def first_or_default(self, p: Column | None = None, default: Any = None) -> Any:
        rows = self._pick(1, p)
        return rows[0] if rows else default

    def single(self, p: Column | None = None) -> Row:
        rows = self._pick(2, p)
        if len(rows) != 1:
            raise CardinalityError("the sequence contains no elements" if not rows else "the sequence contains more than one element")
        return rows[0]

    def single_or_default(self, p: Column | None = None, default: Any = None) -> Any:
        rows = self._pick(2, p)
        if len(rows) > 1:
            raise CardinalityError("the sequence contains more than one element")
        return rows[0] if rows else default

    def last_row(self, p: Column | None = None) -> Row:
        return (self if p is None else self.where(p)).last().first()

    def last_or_default(self, p: Column | None = None, default: Any = None) -> Any:
        rows = (self if p is None else self.where(p)).last().frame.collect()
        return rows[0] if rows else default

    def element(self, i: int) -> Row:
        rows = self.element_at(i).frame.collect()
        if not rows:
            raise CardinalityError("the sequence contains no elements")
        return rows[0]

    def element_or_default(self, i: int, default: Any = None) -> Any:
        rows = self.element_at(i).frame.collect() if i >= 0 else []
        return rows[0] if rows else default

    # -- aggregates

    def aggregate(self, **named: Column) -> DataFrame:
        """Aggregates over all rows as a one-row DataFrame."""
        return self.frame.agg(*(c.alias(n) for n, c in named.items()))

    def _value(self, c: Column, empty: bool = False) -> Any:
        out = self.frame.agg(c).first()[0]
        if out is None and not empty:
            raise CardinalityError("the sequence contains no elements")
        return out

    def count(self, p: Column | None = None) -> int:
        return self._value(F.count("*") if p is None else F.count_if(p))

    long_count = count

    def sum(self, x: Column | str) -> Any:
        return self._value(sum_or_zero(column(x)))

    def average(self, x: Column | str) -> Any:
        return self._value(F.avg(column(x)))

    def min(self, x: Column | str) -> Any:
        return self._value(F.min(column(x)))

    def max(self, x: Column | str) -> Any:
        return self._value(F.max(column(x)))

    def any(self, p: Column | None = None) -> bool:
        return bool((self if p is None else self.where(p)).frame.limit(1).count())

    def all(self, p: Column) -> bool:
        """False if the predicate is false or null for a row."""
        return not self.frame.where(~F.coalesce(p, F.lit(False))).limit(1).count()

    def contains(self, x: Column | str, value: Any) -> bool:
        return self.any(column(x).eqNullSafe(F.lit(value)))

    def aggregate_fold(self, *_: Any) -> None:
        raise NotSupported("folds over a sequence aren't translated")

    def min_by(self, key: Column | str) -> Query:
        """The whole row of the least key, nulls first, ties by the pending order and id."""
        return self._with(self.frame.orderBy(*ordering.sort_columns([(column(key), False), *self.total_order()])).limit(1))

    def max_by(self, key: Column | str) -> Query:
        return self._with(self.frame.orderBy(*ordering.sort_columns([(column(key), True), *self.total_order()])).limit(1))

    def distinct(self) -> Query:
        return self._with(self.frame.distinct())

    def distinct_by(self, *keys: Column | str) -> Query:
        """The first row by id of each key, nulls being one key."""
        if self.id is None:
            raise InvalidOperation("distinct_by needs an id")
        return self._with(ordering.first_by(self.frame, [column(k) for k in keys], [(F.col(self.id), False)]))

    def count_by(self, key: Column | str, comparer: Any = None) -> Query:
        if comparer is not None:
            raise NotSupported("only the default comparer")
        return Query(self.frame.groupBy(column(key).alias("Key")).agg(F.count("*").alias("Value")))

    def group_by(self, *keys: Column | str, drop_nulls: bool | None = None, **named: Column | str):
        from docframe.plans.grouping import Grouped

        return Grouped.over(self, {**{_name(self.frame, k): column(k) for k in keys}, **{n: column(k) for n, k in named.items()}}, drop_nulls)

    # -- sets

    def concat(self, other: Query) -> Query:
        return self._with(self.frame.unionByName(other.frame))

    def append(self, **values: Any) -> Query:
        """One more row; fields that aren't given are null, an id -1."""
        if self.id and self.id not in values:
            values[self.id] = -1
        row = self.frame.sparkSession.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in self.frame.schema))
        return self._with(self.frame.unionByName(row))

    def _value_key(self) -> Column:
        names = [c for c in self.frame.columns if not c.startswith("__o")]
        return F.col(names[0]) if len(names) == 1 else F.struct(*names)

    def except_(self, other: Query) -> Query:
        return self._with(sets.except_in(self.frame, self._value_key(), other.frame, other._value_key()))

    def intersect(self, other: Query) -> Query:
        return self._with(sets.intersect_in(self.frame, self._value_key(), other.frame, other._value_key()))

    def except_by(self, other: Query, key: Column | str, other_key: Column | str | None = None) -> Query:
        return self._with(sets.except_in(self.frame, column(key), other.frame, column(other_key or key)))

    def intersect_by(self, other: Query, key: Column | str, other_key: Column | str | None = None) -> Query:
        return self._with(sets.intersect_in(self.frame, column(key), other.frame, column(other_key or key)))

    def union_by(self, other: Query, key: Column | str) -> Query:
        """Both sides' rows, the first of each key: of this side before the other, then by id."""
        if self.id is None:
            raise InvalidOperation("union_by needs an id")
        both = self.frame.withColumn("__side", F.lit(0)).unionByName(other.frame.withColumn("__side", F.lit(1)))
        both = both.withColumn("__at", F.struct("__side", self.id))
        return self._with(ordering.first_by(both, [column(key)], [(F.col("__at"), False)]).select(*self.frame.columns))

    # -- joins

    def join(self, inner: Query, outer_key: Column | str, inner_key: Column | str, comparer: Any = None, **result: Column | str) -> Query:
        """Inner join on one key. ``result`` names columns; those of the inner side as ``inner.x``, of the outer as ``outer.x``."""
        return self._joined(inner, outer_key, inner_key, "inner", comparer, result)

    def left_join(self, inner: Query, outer_key: Column | str, inner_key: Column | str, comparer: Any = None, **result: Column | str) -> Query:
        return self._joined(inner, outer_key, inner_key, "left", comparer, result)

    def _joined(self, inner: Query, outer_key: Any, inner_key: Any, how: str, comparer: Any, result: dict) -> Query:
        if comparer is not None:
            raise NotSupported("only the default comparer")
        if isinstance(outer_key, (tuple, list)) or isinstance(inner_key, (tuple, list)):
            raise NotSupported("composite join keys")
        left = self.frame.withColumn("__lk", column(outer_key)).alias("outer")
        right = inner.frame.withColumn("__rk", column(inner_key)).alias("inner")
        both = left.join(right, F.col("__lk") == F.col("__rk"), how)
        picked = [column(c).alias(n) for n, c in result.items()]
        return Query(both.select(*picked) if picked else both.drop("__lk", "__rk"), id=self.id)

    def group_join(self, inner: Query, outer_key: Column | str, inner_key: Column | str):
        from docframe.plans.groupjoin import GroupJoin

        if self.id is None:
            raise InvalidOperation("group_join needs an id")
        if isinstance(outer_key, (tuple, list)) or isinstance(inner_key, (tuple, list)):
            raise NotSupported("composite join keys")
        return GroupJoin.over(self, inner, column(outer_key), column(inner_key))

    def where_exists(self, inner: Query, outer_key: Column | str, inner_key: Column | str) -> Query:
        return self._with(sets.intersect_in(self.frame, column(outer_key), inner.frame, column(inner_key)))

    def where_not_exists(self, inner: Query, outer_key: Column | str, inner_key: Column | str) -> Query:
        return self._with(sets.except_safe(self.frame, column(outer_key), inner.frame.where(column(inner_key).isNotNull()), column(inner_key)))

    def apply(self, f: Callable[[DataFrame], DataFrame]) -> Query:
        return self._with(f(self.frame))

    def __getattr__(self, name: str):
        if name in ("reverse", "zip", "prepend", "sequence_equal"):
            raise NotSupported(f"{name} isn't translated")
        raise AttributeError(name)


@dataclass(frozen=True)
class Projected(Query):
    """A projection that still carries its order in hidden columns."""

    shown: tuple[str, ...] = ()

    @property
    def df(self) -> DataFrame:
        return self.frame.orderBy(*ordering.sort_columns(self.keys)).select(*self.shown)

    def _with(self, frame: DataFrame, **changes) -> Query:
        if all(f"__o{i}" in frame.columns for i in range(len(self.keys))) and "keys" not in changes:
            return replace(self, frame=frame)
        return Query(frame.select(*self.shown) if set(self.shown) <= set(frame.columns) else frame, changes.get("keys", ()), self.id, self.kind)

    def take(self, n: int) -> Query:
        return replace(self, frame=self.frame.orderBy(*ordering.sort_columns(self.keys)).limit(n))

    def skip(self, n: int) -> Query:
        return replace(self, frame=self.frame.orderBy(*ordering.sort_columns(self.keys)).offset(n))

    def distinct(self) -> Query:
        """Values once each, in the order of their first occurrence."""
        least = [F.max(F.col(f"__o{i}")).alias(f"__o{i}") if down else F.min(F.col(f"__o{i}")).alias(f"__o{i}") for i, (_, down) in enumerate(self.keys)]
        return replace(self, frame=self.frame.groupBy(*self.shown).agg(*least))


def _name(frame: DataFrame, key: Column | str) -> str:
    return key if isinstance(key, str) else frame.select(key).columns[0]


def sum_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))
