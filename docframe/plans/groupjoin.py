"""Group joins: every outer row with the group of inner rows of its key."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.plans.grouping import GroupChain
from docframe.plans.query import Query
from docframe.plans.relations import ManyChain


class GroupJoinChain(ManyChain):
    """A chain over joined groups: the operators of to-many chains, but a null predicate fails ``all``."""

    def all(self, p: Column, name: str = "all", nulls_pass: bool = False) -> DataFrame:
        return GroupChain.all(self, p, name, nulls_pass)


@dataclass(frozen=True)
class GroupJoin:
    outer: Query
    inner: Query
    outer_key: Column
    inner_key: Column

    @classmethod
    def over(cls, outer: Query, inner: Query, outer_key: Column, inner_key: Column) -> GroupJoin:
        return cls(outer, inner, outer_key, inner_key)

    def select(self, *outer: str, **aggregates: Column) -> Query:
        """Outer columns and aggregates of the group. Inner rows are aggregated by key before the join, so no outer row
        is repeated; a missing group gives 0 for counts and sums written with coalesce, null otherwise."""
        grouped = self.inner.frame.groupBy(self.inner_key.alias("__rk")).agg(*(c.alias(n) for n, c in aggregates.items()))
        empty = self.inner.frame.limit(0).agg(*(c.alias(n) for n, c in aggregates.items())).first().asDict()
        both = self.outer.frame.withColumn("__lk", self.outer_key).join(grouped, F.col("__lk") == F.col("__rk"), "left")
        filled = [F.when(F.col("__rk").isNull(), F.lit(empty[n])).otherwise(F.col(n)).alias(n) if empty[n] is not None and not isinstance(empty[n], list) else F.col(n) for n in aggregates]
        return Query(both.select(*(outer or self.outer.frame.columns), *filled), self.outer.keys, self.outer.id)

    def chain(self, capture: tuple[str, ...] = ()) -> GroupJoinChain:
        """A query inside each outer row's group; terminals give outer rows' ids with the value. ``capture`` names outer columns
        that predicates may use, as ``outer_<name>``."""
        ids = self.outer.frame.select(F.col(self.outer.id).alias("__g_" + self.outer.id), self.outer_key.alias("__lk"), *(F.col(c).alias(f"outer_{c}") for c in capture))
        frame = ids.join(self.inner.frame.withColumn("__rk", self.inner_key), F.col("__lk") == F.col("__rk")).drop("__lk", "__rk")
        return GroupJoinChain(frame, (self.outer.id,), self.outer.frame.select(self.outer.id), self.inner.id)

    def flatten(self) -> DataFrame:
        """One row for each pair, and one with nulls for an outer row without a group (a left join)."""
        right = self.inner.frame.withColumn("__rk", self.inner_key).alias("inner")
        return self.outer.frame.withColumn("__lk", self.outer_key).alias("outer").join(right, F.col("__lk") == F.col("__rk"), "left")

    def with_order(self, *keys: Column) -> GroupJoin:
        return replace(self, inner=self.inner.order_by(*keys))
