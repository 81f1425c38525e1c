"""Connected components over an edge table, by hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.session import cut, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``edges`` (a, b), component the smallest reachable id.

    Each round hooks a node's parent to the smallest grandparent among its neighbours
    and then halves the paths, so the rounds grow with the logarithm of the longest
    chain. All sides are aggregated before they are joined, which keeps a node of very
    many edges out of any single task. Only a count reaches the driver. Self loops,
    repeated edges and an empty table are fine; edges with a null end are ignored."""
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    both = cut(edges.union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("f")))
    while True:
        up = labels.select(F.col("id").alias("f"), F.col("f").alias("g"))
        old = labels.join(up, "f").select("id", "f", "g")
        near = both.join(old.select(F.col("id").alias("b"), F.col("g").alias("h")), "b").groupBy(F.col("a").alias("id")).agg(F.min("h").alias("h"))
        seen = old.join(near, "id")
        offers = F.array(
            F.struct(F.col("id"), F.least("h", "g").alias("f")),
            F.struct(F.col("f").alias("id"), F.least("h", "g").alias("f")),
        )
        hooked = seen.select(F.inline(offers)).groupBy("id").agg(F.min("f").alias("f"))
        fresh = cut(hooked)
        moved = fresh.join(labels.withColumnRenamed("f", "was"), "id").where("f <> was").limit(1).count()
        release(labels)
        labels = fresh
        if not moved:
            release(both)
            return labels.select("id", F.col("f").alias("component"))
