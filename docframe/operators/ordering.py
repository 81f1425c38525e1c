"""Order-dependent operators without a global sort or a single-partition window.

An order is a list of ``(column, descending)`` keys that ends in a unique one. "Before" and
"after" a row are then comparisons of keys, so prefixes of an ordered collection are filters against
one boundary row, found by a distributed top-1."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Key = tuple[Column, bool]


def sort_columns(order: Sequence[Key]) -> list[Column]:
    """Nulls come first ascending and last descending."""
    return [c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in order]


def reverse(order: Sequence[Key]) -> list[Key]:
    return [(c, not down) for c, down in order]


def _before(order: Sequence[Key], marks: Sequence[Column]) -> Column:
    """Whether a row's keys come strictly before the marks."""
    out = F.lit(False)
    for (c, down), m in reversed(list(zip(order, marks, strict=True))):
        less = (c > m) | (c.isNotNull() & m.isNull()) if down else (c < m) | (c.isNull() & m.isNotNull())
        out = F.coalesce(less, F.lit(False)) | (c.eqNullSafe(m) & out)
    return out


def _ahead(df: DataFrame, order: Sequence[Key], p: Column) -> Column:
    """Whether a row comes before the first one that fails ``p``. That row's keys are a scalar sub-query, run once."""
    fails = ~F.coalesce(p, F.lit(False))
    keys = F.struct(*(c.alias(f"k{i}") for i, (c, _) in enumerate(order)))
    first = df.where(fails).orderBy(*sort_columns(order)).limit(1).select(keys).scalar()
    return first.isNull() | _before(order, [first[f"k{i}"] for i in range(len(order))])


def take_while(df: DataFrame, order: Sequence[Key], p: Column) -> DataFrame:
    """Rows before the first one, in order, for which ``p`` isn't true."""
    return df.where(_ahead(df, order, p))


def skip_while(df: DataFrame, order: Sequence[Key], p: Column) -> DataFrame:
    return df.where(~_ahead(df, order, p))


def take_while_by(df: DataFrame, owner: Sequence[Column], order: Sequence[Key], p: Column, skip: bool = False) -> DataFrame:
    """take_while or skip_while within each owner's rows: a running count of failures."""
    w = Window.partitionBy(*owner).orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    failed = F.sum(F.when(F.coalesce(p, F.lit(False)), 0).otherwise(1)).over(w)
    out = df.withColumn("__failed", failed)
    return out.where(F.col("__failed") > 0 if skip else F.col("__failed") == 0).drop("__failed")


def number_by(df: DataFrame, owner: Sequence[Column], order: Sequence[Key], name: str = "__row") -> DataFrame:
    """``df`` with each row's position (from 1) within its owner's."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*owner).orderBy(*sort_columns(order))))


def rank_by(df: DataFrame, owner: Sequence[Column], order: Sequence[Key], name: str = "rank", dense: bool = False) -> DataFrame:
    """``df`` with each row's rank within its owner's: rows of equal order share one, and leave a gap unless ``dense``."""
    ranked = (F.dense_rank() if dense else F.rank()).over(Window.partitionBy(*owner).orderBy(*sort_columns(order)))
    return df.withColumn(name, ranked.cast("long"))


def running_by(df: DataFrame, owner: Sequence[Column], order: Sequence[Key], **aggregates: Column) -> DataFrame:
    """``df`` with aggregates over each row and those before it within its owner's."""
    w = Window.partitionBy(*owner).orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *(a.over(w).alias(n) for n, a in aggregates.items()))


def page_by(df: DataFrame, owner: Sequence[Column], order: Sequence[Key], skip: int = 0, take: int | None = None) -> DataFrame:
    out = number_by(df, owner, order).where(F.col("__row") > skip)
    return (out if take is None else out.where(F.col("__row") <= skip + take)).drop("__row")


def first_by(df: DataFrame, keys: Sequence[Column], order: Sequence[Key]) -> DataFrame:
    """The first row of each key. With one plain ascending id as order this is an aggregate, combined before
    the shuffle, so a key with very many rows stays small; otherwise a window with a limit per group."""
    if len(order) == 1 and not order[0][1]:
        row = F.min_by(F.struct(*df.columns), F.struct(order[0][0]))
        return df.groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(keys))).agg(row.alias("__row")).select("__row.*")
    return number_by(df, keys, order).where("__row = 1").drop("__row")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
