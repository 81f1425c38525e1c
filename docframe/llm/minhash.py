"""Near-duplicate detection with b-bit MinHash signatures.

A first Arrow pass turns a text into its distinct word shingles and keeps, per document, the
size and a 128-bit key of the set and a hash of each band of whole minima. Documents that
share a band with another get, in a second pass, their sets and signatures: the low ``BITS``
bits of the minima of ``PERMS`` hash functions, packed into longs. Signatures are compared by
bit counts in the JVM and corrected for chance collisions, which throws out most
candidates; the rest are confirmed on the full shingle sets.

Skew: equal sets become one class before anything is paired, so copies never meet. In a
bucket, members are first tried against the bucket's smallest class only. What a bucket
still holds of other components is then tried against the bucket, so pairs already known
to be connected are never formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import arrow_map, inputs, mix, slices, texts_of, U, word_hashes
from docframe.llm.components import connected_components
from docframe.session import cut, release

PERMS, BITS, BANDS, ROWS = 2048, 1, 25, 5
#: Standard deviations by which an estimate may fall short before a candidate is dropped.
MARGIN = 4.5
_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLIERS = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) * U(2) + U(1)
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_BAND_SEEDS = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
#: Bits, a document, of the filter that tells which documents may need their sets, and bits that it may have (16 MiB); where
#: that is too few, texts are joined with the documents before they are hashed.
FILTER_EACH, FILTER_BITS = 8, 1 << 27

FEATURES = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>"
SETS = "id long, shingles array<long>, signature array<long>, bands array<long>"


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text one after another, and how many each has.
    A text of fewer words than a shingle has its whole sequence as the one member."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    joined = np.zeros(len(hashes), U)
    n = len(hashes)
    for k in range(words):
        joined[: max(0, n - k)] += hashes[k:] * _PLACES[k]
    joined = mix(joined)
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        if not count:
            continue
        if count < words:
            part = mix((hashes[end - count : end] * _PLACES[:count]).sum(dtype=U, keepdims=True) + _PLACES[63 - count])
        else:
            part = np.sort(joined[end - count : end - words + 1])
            if len(part) > 1:
                fresh = np.empty(len(part), bool)
                fresh[0] = True
                np.not_equal(part[1:], part[:-1], out=fresh[1:])
                part = part[fresh]
        sizes[i] = len(part)
        parts.append(part)
    return (np.concatenate(parts) if parts else np.zeros(0, U)), sizes


def _minima(members: np.ndarray, sizes: np.ndarray, perms: int) -> Iterator[np.ndarray]:
    """For each hash function, the mixed minima of every set of at least one member."""
    starts = np.concatenate([[0], np.cumsum(sizes[sizes > 0])[:-1]]).astype(np.int64)
    scratch = np.empty(len(members), U)
    for p in range(perms):
        np.multiply(members, _MULTIPLIERS[p], out=scratch)
        yield mix(np.minimum.reduceat(scratch, starts))


def signatures(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The low bits of all minima, packed, for every set of at least one member."""
    per = 64 // BITS
    packed = np.zeros((int((sizes > 0).sum()), PERMS // per), U)
    for p, least in enumerate(_minima(members, sizes, PERMS)):
        packed[:, p // per] |= (least & U((1 << BITS) - 1)) << U(BITS * (p % per))
    return packed


def band_hashes(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each band of whole minima for every set of at least one member."""
    out = np.tile(_BAND_SEEDS, (int((sizes > 0).sum()), 1))
    for p, least in enumerate(_minima(members, sizes, BANDS * ROWS)):
        out[:, p // ROWS] += least * _PLACES[p % ROWS]
    return mix(out)


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def features(docs: DataFrame, words: int) -> DataFrame:
    """FEATURES per row of ``docs``; a row without words has a size of 0 and null lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                members, sizes = shingle_sets(texts_of(part), words)
                full = sizes > 0
                keys = np.zeros((2, len(sizes)), U)
                bands = pa.nulls(len(sizes), pa.list_(pa.int64()))
                if full.any():
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64)
                    keys[0, full] = np.add.reduceat(members, starts)
                    keys[1, full] = np.bitwise_xor.reduceat(members * _PLACES[9], starts)
                    bands = _lists(band_hashes(members, sizes)).take(pa.array(np.cumsum(full) - 1, mask=~full))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), *(pa.array(k.view(np.int64)) for k in keys), bands],
                    ["doc_id", "n_shingles", "key1", "key2", "bands"],
                )

    return arrow_map(inputs(docs, doc_id="long", text="string"), run, FEATURES)


def _filter_of(ids: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of ``size`` bits over column ``id``, OR-ed on the executors; at most
    size / 64 longs reach the driver."""
    bits = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(size)) for k in (1, 2)))).alias("bit"))
    rows = bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("set")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["set"].to_numpy()
    return out


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """SETS of the documents in ``ids`` (id, distinct): a filter as large as their number asks for keeps the
    other texts from being hashed again, and a semi join removes its few false hits. More ids than a
    filter of bounded size can tell apart are joined with the texts first."""
    spark = docs.sparkSession
    size = 1 << max(16, (FILTER_EACH * ids.count() - 1).bit_length())
    keyed = inputs(docs, doc_id="long", text="string").withColumnRenamed("doc_id", "id").where("id is not null")
    bits = spark.sparkContext.broadcast(_filter_of(ids, size) if size <= FILTER_BITS else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bits.value
        for batch in batches:
            if wanted is not None:
                hit = np.ones(len(batch), bool)
                for name in ("h1", "h2"):
                    at = batch.column(name).to_numpy()
                    hit &= (wanted[at >> 6] >> (at & 63)) & 1 == 1
                batch = batch.filter(pa.array(hit))
            for part in slices(batch.select(["id", "text"])):
                members, sizes = shingle_sets(texts_of(part), words)
                if not sizes.all():  # a false hit without words
                    part, sizes = part.filter(pa.array(sizes > 0)), sizes[sizes > 0]
                if not len(sizes):
                    continue
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(members.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, _lists(signatures(members, sizes)), _lists(band_hashes(members, sizes))], ["id", "shingles", "signature", "bands"])

    if size > FILTER_BITS:
        return arrow_map(keyed.join(ids, "id", "left_semi"), run, SETS)
    for k in (1, 2):
        keyed = keyed.withColumn(f"h{k}", F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(size)))
    return arrow_map(keyed, run, SETS).join(ids, "id", "left_semi")


def estimate(left: str, right: str) -> Column:
    """Similarity from two packed signatures: a slot differs if any of its bits does; equal
    slots by chance (one in 2**BITS) are corrected for."""
    one = sum(1 << i for i in range(0, 64, BITS))
    keep = f" & {one - (one >> 63 << 64)}L" if BITS > 1 else ""
    differing = []
    for i in range(PERMS * BITS // 64):
        x = f"({left}[{i}] ^ {right}[{i}])"
        for shift in (n for n in (4, 2, 1) if n < BITS):
            x = f"({x} | shiftrightunsigned({x}, {shift}))"
        differing.append(f"bit_count({x}{keep})")
    chance = 1 / (1 << BITS)
    return F.expr(f"((1 - ({' + '.join(differing)}) / {PERMS}D) - {chance}D) / {1 - chance}D")


def _slack(percent: int) -> float:
    j, chance = percent / 100, 1 / (1 << BITS)
    p = j + (1 - j) * chance
    return MARGIN * math.sqrt(p * (1 - p) / PERMS) / (1 - chance)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("s", "t")))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.size("s") + F.size("t") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is at least ``percent`` hundredths. ``component_id`` is the smallest doc_id
    reachable over links; ``kept`` marks that document.

    Null and empty texts, and texts of white space, have no shingles and no links. A null
    doc_id has a null component and is kept. Repeated rows of a doc_id each get a row. An
    empty table gives no rows. Other columns are ignored."""
    rows = cut(features(docs, words))
    classes = cut(
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("key1", "key2", "n_shingles")
        .agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"))
    )
    bands = classes.select("id", F.explode("bands").alias("bucket"))
    heads = bands.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("bucket", "head")
    members = cut(bands.join(heads, "bucket"))
    sets = cut(sets_of(docs, members.select("id").distinct(), words))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), F.size("shingles").alias(f"n_{name}"), F.col("signature").alias(f"sig_{name}"), F.col("bands").alias(f"bands_{name}"))

    possible = (F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")) & (estimate("sig_a", "sig_b") >= percent / 100 - _slack(percent))
    stars = members.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b").where(possible)
    best = stars.groupBy("a").agg(F.max(F.struct(estimate("sig_a", "sig_b").alias("near"), "b")).alias("top")).select("a", "top.b")
    first = cut(_confirm(best, sets, percent))
    known = connected_components(first)

    labelled = members.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    owner = labelled.where("id = head").select("bucket", F.col("component").alias("owner"))
    labelled = cut(labelled.join(owner, "bucket").select("bucket", "id", "component", "owner"))
    odd = labelled.where("component <> owner").select("bucket", F.col("id").alias("a"), F.col("component").alias("c_a"))
    rest = labelled.join(odd.select("bucket").distinct(), "bucket", "left_semi").select("bucket", F.col("id").alias("b"), F.col("component").alias("c_b"), "owner")
    # a pair counts in the first bucket that both are in, so it is made once
    new = F.expr("element_at(filter(bands_a, x -> array_contains(bands_b, x)), 1) = x.bucket and c_a <> c_b and (c_b = owner or a < b)")
    met = [F.col("x.bucket") == F.col("y.bucket"), possible, new]
    pairs = odd.join(side("a"), "a").alias("x").join(rest.join(side("b"), "b").alias("y"), met).select("a", "b").distinct()
    second = cut(_confirm(pairs, sets, percent))
    groups = connected_components(first.union(second))
    for done in (members, sets, labelled):
        release(done)

    of_class = classes.select("key1", "key2", "n_shingles", "id").join(groups, "id", "left").select("key1", "key2", "n_shingles", F.coalesce("component", "id").alias("component"))
    out = rows.select("doc_id", "n_shingles", "key1", "key2").join(of_class, ["key1", "key2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


#: DuckDB's words for near_duplicates over documents with three words and 0.85.
SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
listed AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END AS xs FROM word),
shingle AS (SELECT DISTINCT doc_id, unnest(xs) AS x FROM listed),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * pair.n >= 85 * (p.n + q.n - pair.n)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON r.id = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN size s USING (doc_id) JOIN (SELECT id, min(root) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""
