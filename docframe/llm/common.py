"""Text primitives the operators share: byte-level words, vectorised hashes, batch slicing."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes a Python worker handles at once, and bytes of an Arrow batch; only a single longer document exceeds them.
SLICE_BYTES, BATCH = 1 << 20, "4m"

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(docs: DataFrame, name: str) -> int:
    """The place of column ``name``: the one spelled so, or else the first that differs in case only."""
    columns = docs.columns
    for wanted, names in ((name, columns), (name.lower(), [c.lower() for c in columns])):
        if wanted in names:
            return names.index(wanted)
    raise KeyError(f"no column {name} among {', '.join(columns)}")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ... by place: whatever they were called (the same but for
    case, or like a name that an operator makes up), none is ambiguous."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def inputs(docs: DataFrame, **kinds: str) -> DataFrame:
    """The columns that an operator reads, by name and type; whatever else ``docs`` holds is left out."""
    return numbered(docs).select(*(F.col(f"c{place(docs, n)}").cast(kind).alias(n) for n, kind in kinds.items()))


def _trim() -> None:
    """Give freed memory back: workers outlive their task, and their memory adds to that of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of bounded bytes, so that neither side's memory depends on how long the
    documents are. A limit that the session sets itself is kept."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, BATCH)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(task, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + (1 << 16)), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes that are not ASCII white space, A-Z lowered) of all
    texts in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    summed = np.empty(len(data) + 1, U)
    summed[0] = 0
    np.cumsum(_BYTE[data] * _power(_BASE, len(data))[: len(data)], out=summed[1:])
    raw = (summed[ends] - summed[starts]) * _power(_BASE_INVERSE, len(data))[starts]
    bounds = np.searchsorted(starts, np.cumsum(sizes))
    return mix(raw), np.diff(bounds, prepend=0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` holds about ``limit`` bytes at most."""
    col = batch.column(column)
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text, a null being empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.large_binary()).to_pylist()]
