"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets come from source totals alone. Each source's documents fall into shards of bounded
size; a shard, in seeded order, is a stream of words cut into blocks of equal size. The blocks
of a source's target are apportioned to its shards by highest quotients, and each
shard takes whole passes over its stream and then its first blocks in seeded order. What a
document gives is the part of the taken blocks that lies in it.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import inputs, numbered, place
from docframe.session import cut

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 17
#: Least documents of a shard on average, and words of a block. Shards grow with the square root of
#: their source, so that neither a shard nor a source's list of shards is ever long.
SHARD_DOCS, BLOCK = 2_000, 64
#: Blocks that the smallest target holds at least, if need be by blocks of fewer words.
LEAST_BLOCKS = 16
#: Rows of identical documents that are dealt out together.
TOGETHER = 10_000


def size_of(text: str) -> Column:
    """Words (runs without ASCII white space) of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source: all words shared by the weights, which sources get in code point
    order (null last), repeating; a source's target stops at ``most`` times its size, and
    the excess is shared again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), list(names)
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def apportion(votes: list[float], seats: int) -> list[int]:
    """Sainte-Laguë: seats by the highest quotients vote / (2 n + 1), earlier entries winning ties.
    The divisor is found by bisection, the last few seats one at a time."""
    total = sum(votes)
    if not total or not seats:
        return [0] * len(votes)
    low, high = total / (2 * seats + 2 * len(votes) + 2), 2.0 * total / max(1, seats) + max(votes) * 2.0
    count = lambda d: [math.floor(v / d + 0.5) for v in votes]
    for _ in range(100):
        middle = (low + high) / 2
        if sum(count(middle)) > seats:
            low = middle
        else:
            high = middle
    out = count(high)
    heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, out, strict=True)) if v]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _quotas(shards: DataFrame, goals: DataFrame, block: int) -> DataFrame:
    """``source, shard, words, quota``: the words each shard takes, in blocks by highest quotients.

    In the divisor method a shard of v votes has floor(v / d + 1/2) seats. With d = votes / seats of
    the source that is off by a few; those go by the next (or last) quotients, ranked
    among the shards of the source."""
    base = shards.join(goals, F.col("source").eqNullSafe(F.col("g_source")))
    base = base.withColumn("ideal", F.coalesce(F.try_divide(F.col("seats") * F.col("words"), F.col("source_size")), F.lit(0.0))).withColumn("first", F.floor(F.col("ideal") + 0.5).cast("long"))
    base = base.withColumn("miss", F.expr("seats - sum(first) over (partition by source)"))
    # Shards that may gain rank by their next quotient, those that may lose by their last one.
    base = base.withColumn("next", F.col("words") / (2 * F.col("first") + 1)).withColumn("last", F.when(F.col("first") > 0, F.col("words") / (2 * F.col("first") - 1)))
    base = base.withColumn("up", F.expr("row_number() over (partition by source order by next desc, shard)")).withColumn("down", F.expr("row_number() over (partition by source order by last is null, last, shard desc)"))
    step = F.when((F.col("miss") > 0) & (F.col("up") <= F.col("miss")), 1).when((F.col("miss") < 0) & (F.col("down") <= -F.col("miss")), -1).otherwise(0)
    return base.withColumn("quota", (F.col("first") + step) * block)


def block_size(goals: dict[str | None, float], block: int = BLOCK) -> int:
    """Words of a block: ``block``, or fewer where the smallest target would else come to nothing."""
    some = [g for g in goals.values() if g > 0]
    return max(1, min(block, math.floor(min(some) / LEAST_BLOCKS))) if some else block


def _sized(rows: DataFrame, seed: int) -> DataFrame:
    """``source, doc_id, draw, size`` of ``rows`` (doc_id, text, source); what else they have stays."""
    return rows.select("*", size_of("text").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"))


def _shares(sized: DataFrame, weights: tuple, most: int, block: int) -> DataFrame:
    """``source, doc_id, draw, size, n, source_size, target, words``: for each group of n rows of one source, id,
    draw and size, the words that the mix takes of all its rows.

    Rows alike are counted before they are shuffled, so repeated rows meet nowhere."""
    spark = sized.sparkSession
    groups = cut(sized.groupBy("source", "doc_id", "draw", "size").agg(F.count("*").alias("n")))
    totals = {r.source: (int(r.n), int(r.words)) for r in groups.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words")).collect()}
    goal = targets({s: w for s, (_, w) in totals.items()}, weights, most)
    names, block = list(goal), block_size(goal, block)
    seats = dict(zip(names, apportion([goal[s] for s in names], round(sum(goal.values()) / block)), strict=True))
    rows = [(s, w, goal[s], seats[s], -(-n // max(SHARD_DOCS, math.isqrt(4 * n)))) for s, (n, w) in totals.items()]
    goals = spark.createDataFrame(rows, "g_source string, source_size long, target double, seats long, n_shards long")
    keyed = groups.join(goals, F.col("source").eqNullSafe(F.col("g_source"))).withColumn("shard", F.expr("pmod(draw, n_shards)")).withColumn("all", F.expr("n * size"))
    shards = keyed.groupBy("source", "shard").agg(F.sum("all").alias("words"))
    quotas = _quotas(shards, goals.select("g_source", "source_size", "seats"), block).select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "words", "quota")
    placed = keyed.withColumn("end", F.expr("sum(all) over (partition by source, shard order by draw, doc_id, size rows unbounded preceding)"))
    both = placed.join(quotas, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    return both.selectExpr("source", "doc_id", "draw", "size", "n", "source_size", "target", f"{_taken(most)} as words")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (doc_id, text, source).

    ``taken`` counts a document's words in the mix, repeats included, and is at most ``most`` times its
    size. A null text has size 0 and gives nothing; null sources are one source, the last. Rows
    of one doc_id count each by itself, in the order of their hashes and then sizes, and rows alike
    share evenly what all of them give, to a word. An empty table gives no rows, other columns are
    ignored. Reruns agree, whatever the partitions."""
    sized = _sized(inputs(docs, doc_id="long", text="string", source="string"), seed).drop("text")
    shares = _shares(sized, weights, most, block)
    some = shares.withColumn("at", F.explode(F.expr(f"sequence(0L, (n - 1) div {TOGETHER})"))).hint("rebalance")
    each = some.withColumn("i", F.explode(F.expr(f"sequence(at * {TOGETHER}, least(n, (at + 1) * {TOGETHER}) - 1)")))
    return each.selectExpr("doc_id", "size", "source_size", "target", "words div n + if(i < words % n, 1, 0) as taken")


def _taken(most: int) -> str:
    """Whole passes over the shard and, of the rest, what lies in the document."""
    quota = f"least(quota, {most} * words)"
    passes = f"coalesce(cast(floor(try_divide({quota}, words)) as long), 0)"
    rest = f"({quota} - words * {passes})"
    return f"all * {passes} + greatest(0, least(all, {rest} - (end - all)))"


def mix_rows(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """The mix itself: each row of ``docs`` (doc_id, text, source) as often as the whole passes over its shard, and
    once more if the rest takes half of its words or more. All columns stay, whatever their names, and texts stay whole.

    Rows of one doc_id but of other texts or sources count each by itself, rows alike the same number of times. Null
    and empty texts give no rows, nor does an empty table; null ids and null sources are mixed like others."""
    flat, names = numbered(docs), ("doc_id", "text", "source")
    key, text, source = (F.col(f"c{place(docs, n)}").cast(kind) for n, kind in zip(names, ("long", "string", "string"), strict=True))
    rows = flat.select("*", key.alias("doc_id"), text.alias("text"), source.alias("source"))
    shares = _shares(_sized(inputs(docs, doc_id="long", text="string", source="string"), seed).drop("text"), weights, most, block)
    times = F.expr("cast(if(size > 0, floor(words / (size * n) + 0.5D), 0) as int)").alias("s_times")
    shares = shares.select(F.col("source").alias("s_source"), F.col("doc_id").alias("s_id"), F.col("draw").alias("s_draw"), F.col("size").alias("s_size"), times).where("s_times > 0")
    met = (F.col("draw") == F.col("s_draw")) & F.col("doc_id").eqNullSafe(F.col("s_id")) & F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size"))
    joined = _sized(rows, seed).join(shares, met).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("s_times"))))
    return joined.select(flat.columns).toDF(*docs.columns)
