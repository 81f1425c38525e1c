"""Folds by doc_id and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % parts


def held_out(doc_id: str, parts: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, parts) == remainder, F.lit(False))


def bounded_sample(rows: DataFrame, by: str, each: int, key: str = "doc_id") -> DataFrame:
    """About ``each`` rows of every value of ``by``, drawn by a hash of ``key``: whichever
    order rows come in, the same ones. The draw is a filter, so no value's rows meet in one task,
    and yields 1.1 * ``each`` rows a value on average at most. Column ``weight`` says how many rows a drawn one
    stands for. ``by`` is a label that a model keeps something for anyway; its values and their
    counts reach the driver."""
    counts = {r[0]: r[1] for r in rows.groupBy(by).agg(F.count("*")).collect()}
    chance = F.lit(0.0)
    for value, n in counts.items():
        chance = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, 1.1 * each / n))).otherwise(chance)
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 60)) < chance * (1 << 60)).withColumn("weight", F.try_divide(F.lit(1.0), chance))
