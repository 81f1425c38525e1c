"""Groups: aggregates, having, order by aggregate, and chained queries inside groups."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.errors import NotSupported
from docframe.operators import ordering
from docframe.plans.query import Query, column, sum_or_zero

_DROPPING = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


@dataclass(frozen=True)
class Grouped:
    """Rows grouped by named keys. Aggregates are computed with partial aggregation and one shuffle."""

    source: Query
    keys: tuple[tuple[str, Column], ...]
    havings: tuple[tuple[str, Column], ...] = ()

    @classmethod
    def over(cls, source: Query, keys: dict[str, Column], drop_nulls: bool | None) -> Grouped:
        """``drop_nulls``: whether rows with a null key are left out. By default they are for numbers, booleans, dates and
        times, and for every part of a composite key; a null string is a group."""
        types = source.frame.select(*(k.alias(n) for n, k in keys.items())).schema
        frame = source.frame
        for n, k in keys.items():
            if drop_nulls or (drop_nulls is None and (len(keys) > 1 or isinstance(types[n].dataType, _DROPPING))):
                frame = frame.where(k.isNotNull())
        return cls(replace(Query(frame, id=source.id, kind=source.kind)), tuple(keys.items()))

    def _keyed(self) -> list[Column]:
        return [k.alias(n) for n, k in self.keys]

    def select(self, **members: Column) -> Query:
        """One row a group: members are aggregates, key columns by name, or expressions of both."""
        names = {n for n, _ in self.keys}
        plain = {n: c for n, c in members.items() if isinstance(c, str)}
        if not set(plain.values()) <= names:
            raise NotSupported(f"not a key or an aggregate: {set(plain.values()) - names}")
        aggregates = [c.alias(n) for n, c in members.items() if n not in plain]
        extra = [c.alias(n) for n, c in self.havings]
        out = self.source.frame.groupBy(*self._keyed()).agg(*(aggregates + extra or [F.count("*").alias("__n")]))
        for n, _ in self.havings:
            out = out.where(F.col(n))
        return Query(out.select(*(F.col(plain[n]).alias(n) if n in plain else F.col(n) for n in members)))

    def having(self, condition: Column) -> Grouped:
        """Groups for which a condition over aggregates holds."""
        return replace(self, havings=(*self.havings, (f"__h{len(self.havings)}", condition)))

    where = having

    def items(self) -> Query:
        """``Key, Items``: each group's rows as a list, ordered by id where there is one."""
        frame, source = self.source.frame, self.source
        row = F.struct(*([source.id] if source.id else []), *(c for c in frame.columns if c != source.id))
        key = self.keys[0][1] if len(self.keys) == 1 else F.struct(*self._keyed())
        items = F.collect_list(row)
        return Query(frame.groupBy(key.alias("Key")).agg((F.array_sort(items) if source.id else items).alias("Items")))

    def chain(self) -> GroupChain:
        """A query inside every group, as by ``g => g.Where(..).OrderBy(..).Take(..)...``."""
        names = [n for n, _ in self.keys]
        frame = self.source.frame.select("*", *(k.alias(f"__g_{n}") for n, k in self.keys))
        return GroupChain(frame, tuple(names), frame.select(*(F.col(f"__g_{n}").alias(n) for n in names)).distinct(), self.source.id)


@dataclass(frozen=True)
class GroupChain:
    """Rows still in groups, keyed by ``__g_*``. Filters and pages are applied within groups; a terminal gives one row a group, all groups of
    the source included."""

    frame: DataFrame
    names: tuple[str, ...]
    groups: DataFrame
    id: str | None
    keys: tuple[ordering.Key, ...] = ()
    value: Column | None = None
    paged: int = 0

    def _owner(self) -> list[Column]:
        return [F.col(f"__g_{n}") for n in self.names]

    def _order(self) -> list[ordering.Key]:
        return [*self.keys, *([(F.col(self.id), False)] if self.id else [])]

    def where(self, p: Column) -> GroupChain:
        return replace(self, frame=self.frame.where(p))

    def order_by(self, *keys: Column | str, descending: bool = False) -> GroupChain:
        return replace(self, keys=tuple((column(k), descending) for k in keys))

    def then_by(self, *keys: Column | str, descending: bool = False) -> GroupChain:
        return replace(self, keys=(*self.keys, *((column(k), descending) for k in keys)))

    def page(self, skip: int = 0, take: int | None = None) -> GroupChain:
        if self.paged:
            raise NotSupported("more than one page boundary in a chain")
        return replace(self, frame=ordering.page_by(self.frame, self._owner(), self._order(), skip, take), paged=1)

    def skip(self, n: int) -> GroupChain:
        return self.page(skip=n)

    def take(self, n: int) -> GroupChain:
        return self.page(take=n)

    def take_while(self, p: Column, skip: bool = False) -> GroupChain:
        if not self.keys:
            raise NotSupported("take_while needs an order")
        return replace(self, frame=ordering.take_while_by(self.frame, self._owner(), self._order(), p, skip))

    def skip_while(self, p: Column) -> GroupChain:
        return self.take_while(p, skip=True)

    def select(self, value: Column | str) -> GroupChain:
        return replace(self, value=column(value))

    def distinct(self) -> GroupChain:
        if self.value is None:
            raise NotSupported("distinct needs a projection")
        frame = self.frame.withColumn("__v", self.value)
        return replace(self, frame=ordering.first_by(frame, [*self._owner(), F.col("__v")], self._order()), value=F.col("__v"))

    # -- terminals: DataFrames of the key columns and the named value

    def _join(self, found: DataFrame) -> DataFrame:
        on = [self.groups[n].eqNullSafe(found[f"__g_{n}"]) for n in self.names]
        return self.groups.join(found, on, "left").drop(*(f"__g_{n}" for n in self.names))

    def aggregate(self, **named: Column) -> DataFrame:
        """Aggregates of each group's remaining rows; null where none remain."""
        return self._join(self.frame.groupBy(*self._owner()).agg(*(c.alias(n) for n, c in named.items())))

    def count(self, name: str = "n", p: Column | None = None) -> DataFrame:
        return self.aggregate(**{name: F.count("*") if p is None else F.count_if(p)}).fillna(0, [name])

    def sum(self, name: str = "sum", x: Column | None = None) -> DataFrame:
        return self.aggregate(**{name: sum_or_zero(self._v(x))}).fillna(0, [name])

    def any(self, name: str = "any", p: Column | None = None) -> DataFrame:
        out = self.aggregate(**{name: F.count("*") > 0 if p is None else F.coalesce(F.bool_or(p), F.lit(False))})
        return out.withColumn(name, F.coalesce(name, F.lit(False)))

    def all(self, p: Column, name: str = "all", nulls_pass: bool = False) -> DataFrame:
        """``nulls_pass``: whether a null predicate counts as kept."""
        return self.aggregate(**{name: F.bool_and(F.coalesce(p, F.lit(nulls_pass)))}).withColumn(name, F.coalesce(name, F.lit(True)))

    def min(self, name: str = "min", x: Column | None = None) -> DataFrame:
        return self.aggregate(**{name: F.min(self._v(x))})

    def max(self, name: str = "max", x: Column | None = None) -> DataFrame:
        return self.aggregate(**{name: F.max(self._v(x))})

    def average(self, name: str = "avg", x: Column | None = None) -> DataFrame:
        return self.aggregate(**{name: F.avg(self._v(x))})

    def contains(self, value, name: str = "contains") -> DataFrame:
        return self.any(name, self._v(None).eqNullSafe(F.lit(value)))

    def to_array(self, name: str = "items") -> DataFrame:
        """The remaining values in order, as a list; empty for a group without any."""
        numbered = ordering.number_by(self.frame.withColumn("__v", self._v(None)), self._owner(), self._order())
        values = F.transform(F.array_sort(F.collect_list(F.struct("__row", "__v"))), lambda x: x["__v"])
        out = self._join(numbered.groupBy(*self._owner()).agg(values.alias(name)))
        return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))

    def element(self, name: str = "first", i: int = 0, last: bool = False, x: Column | None = None) -> DataFrame:
        """The value at a position from the start (or end); null where there is none."""
        order = ordering.reverse(self._order()) if last else self._order()
        numbered = ordering.number_by(self.frame.withColumn("__v", self._v(x)), self._owner(), order)
        return self._join(numbered.where(F.col("__row") == i + 1).select(*self._owner(), F.col("__v").alias(name)))

    def first(self, name: str = "first", x: Column | None = None) -> DataFrame:
        return self.element(name, 0, False, x)

    def last(self, name: str = "last", x: Column | None = None) -> DataFrame:
        return self.element(name, 0, True, x)

    def single(self, name: str = "single", x: Column | None = None) -> DataFrame:
        """The only value; null where there are none or several."""
        return self.aggregate(**{name: F.when(F.count("*") == 1, F.first(self._v(x)))})

    def _v(self, x: Column | None) -> Column:
        if x is None and self.value is None:
            raise NotSupported("the chain needs a projection")
        return self.value if x is None else x

    def min_by(self, *_):
        raise NotSupported("MinBy, MaxBy, DistinctBy and CountBy inside a group")

    max_by = distinct_by = count_by = min_by
