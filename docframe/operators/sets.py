"""Set operators. ``except_in`` and ``intersect_in`` keep repeats and follow SQL's NOT IN and IN on nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes, as planned from the sizes of files, whose rows one task compares in once_each.
SHARE = 2 << 20
#: From this on a planned size says nothing.
UNKNOWN = 1 << 50


def once_each(df: DataFrame) -> DataFrame:
    """``df`` without repeats, for tables of few: rows are dealt by value to as many tasks as the size asks for, so that what a
    task holds doesn't grow with the table, whatever number of partitions the session has or makes of them."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(size // SHARE + 1, *df.columns).distinct() if 0 <= size < UNKNOWN else df.distinct()


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def intersect_in(a: DataFrame, key: Column, b: DataFrame, other: Column) -> DataFrame:
    """Rows of ``a`` whose key is a key of ``b``; null matches nothing."""
    right = b.select(other.alias("__r")).distinct()
    return a.withColumn("__l", key).join(right, F.col("__l") == F.col("__r"), "left_semi").select(*a.columns)


def except_in(a: DataFrame, key: Column, b: DataFrame, other: Column) -> DataFrame:
    """Rows of ``a`` whose key isn't among the keys of ``b``. A null key of ``b`` leaves none, and a null key of ``a``
    only stays if ``b`` has no rows. Joined by key, however large ``b`` is; two facts about it come from a scalar sub-query."""
    right = b.select(other.alias("__r"))
    facts = right.select(F.struct(F.coalesce(F.bool_or(F.col("__r").isNull()), F.lit(False)).alias("has_null"), F.count("*").alias("n"))).scalar()
    left = a.withColumn("__l", key).where((facts["n"] == 0) | (~facts["has_null"] & F.col("__l").isNotNull()))
    return left.join(right.distinct(), F.col("__l") == F.col("__r"), "left_anti").select(*a.columns)


def intersect_safe(a: DataFrame, key: Column, b: DataFrame, other: Column) -> DataFrame:
    """As intersect_in, null matching null."""
    right = b.select(other.alias("__r")).distinct()
    return a.withColumn("__l", key).join(right, F.col("__l").eqNullSafe(F.col("__r")), "left_semi").select(*a.columns)


def except_safe(a: DataFrame, key: Column, b: DataFrame, other: Column) -> DataFrame:
    right = b.select(other.alias("__r")).distinct()
    return a.withColumn("__l", key).join(right, F.col("__l").eqNullSafe(F.col("__r")), "left_anti").select(*a.columns)
