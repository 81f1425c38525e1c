"""Best-fit packing planned on the histogram of piece lengths.

Texts become pieces of at most ``CAPACITY`` tokens in one Arrow pass. The driver sees only how
many pieces have each length (at most ``CAPACITY`` rows) and packs those counts: best fit, longest
first, a whole run of equal sequences at a time. The plan gives, for runs of ranks
within a length, the sequences and offsets they take; each piece finds its slot by its rank.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import arrow_map, inputs, slices
from docframe.session import cut

CAPACITY = 2048
#: Words whose ids a Python worker keeps in each of two generations: when the young one is full it becomes the old
#: one, from which words that come again are taken over. And words that the library gets at once.
CACHE_WORDS, TOGETHER = 200_000, 200
#: Pieces of a length are ranked in buckets of about so many, each in one task.
BUCKET = 20_000
#: Plans of up to so many rows (40 bytes each) are broadcast.
PLAN_ROWS = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A task's rows of one doc_id are told apart by up to so many numbers, so that they share no bucket.
TWINS = 1 << 20

#: Characters that are their own NFC form and on which Python's classes agree with the tokenizer's.
_PLAIN = re.compile("[\\t\\n\\r -~¡-±´-¸º»¿-įı-ſ‐-‧…€]*").fullmatch
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall
_END = struct.pack("<I", 0)


class WordTokenizer:
    """The word-end BPE of a tokenizers file with a cache of whole words. Texts of plain
    characters are split into words here; any other text, and one that spells out an added
    token of the file (the library gives it that token's id), goes to the library as it is."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        added = self.model.get_added_tokens_decoder().values()
        #: Contents of added tokens that are looked for in a text as it is, and in the text in lower case.
        self.added, self.lowered = ([t.content if not t.normalized else t.content.lower() for t in added if t.normalized == n] for n in (False, True))
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _spelled(self, text: str) -> bool:
        return any(x in text for x in self.added) or (bool(self.lowered) and any(x in text.lower() for x in self.lowered))

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: set[str]) -> None:
        again = words & self.old.keys()
        self.known.update((w, self.old[w]) for w in again)
        fresh = list(words - again)
        for at in range(0, len(fresh), TOGETHER):
            some = fresh[at : at + TOGETHER]
            ids = self._encode(" ".join(some))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some) and (not len(ids) or ends[-1] == len(ids)):
                raw, start = ids.tobytes(), 0
                for word, end in zip(some, (ends * 4).tolist(), strict=True):
                    self.known[word] = raw[start:end]
                    start = end
            else:
                for word in some:
                    self.known[word] = self._encode(word).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.old = {}, self.known
        words = [None if not _PLAIN(t) or self._spelled(t) else _WORDS(t.lower()) for t in texts]
        fresh = set(chain.from_iterable(w for w in words if w)).difference(self.known)
        if fresh:
            self.learn(fresh)
        get = self.known.__getitem__
        return [self._encode(t).tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, words, strict=True)]


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """PIECES and ``twin`` per row of ``docs`` (doc_id, text), with their ``ids`` if asked for. A text's ids
    end with id 0, so a null or empty text is one piece of length 1. ``twin`` numbers the rows of
    one doc_id within a task; it is 0 where ids are unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = tokenizer(path or default_tokenizer()), {}
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, raw in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    raw += _END
                    twin = seen[doc] = (seen.get(doc, -1) + 1) % TWINS
                    for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                        one = raw[at : at + 4 * capacity]
                        rows.append((doc, i, at // 4, len(one) // 4, zlib.crc32(one), twin, np.frombuffer(one, "<u4").astype(np.int32) if with_ids else None))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))[: 6 + with_ids]
                cols = list(zip(*rows, strict=True))
                names = [x.split()[0] for x in PIECES.split(", ")] + ["twin"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names)

    return arrow_map(inputs(docs, doc_id="long", text="string"), run, PIECES + ", twin int" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first_rank, last_rank, per_sequence, first_sequence, offset)`` for the counts
    of each length: ranks first to last take ``per_sequence`` slots from ``offset`` on
    in one sequence after another. Best fit, longest first: a piece goes where the least room
    that suffices is left. Open sequences are kept as runs by the room left, at most
    two more after every length."""
    out, opened, rooms, sequences = [], {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = opened[room].pop()
                if not opened[room]:
                    del opened[room], rooms[at]
            else:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            per = room // length
            whole = min(n, left // per)
            parts = [(first, whole, per)] if whole else []
            if whole < n and left > whole * per:
                parts.append((first + whole, 1, left - whole * per))
            for start, some, each in parts:
                out.append((length, rank, rank + some * each - 1, each, start, capacity - room))
                rank, left = rank + some * each, left - some * each
                parts_room = room - each * length
                if parts_room:
                    if parts_room not in opened:
                        opened[parts_room] = []
                        bisect.insort(rooms, parts_room)
                    opened[parts_room].append((start, some))
            used = sum(some for _, some, _ in parts)
            if used < n:
                if room not in opened:
                    opened[room] = []
                    bisect.insort(rooms, room)
                opened[room].append((first + used, n - used))
    return out


def ranked(found: DataFrame, total: int) -> DataFrame:
    """``found`` (a written table) with each piece's ``rank`` (from 0) within its length. Ranks are counted in
    buckets of a length, so that a length that most pieces have isn't one task."""
    buckets = max(1, -(-total // BUCKET))
    keyed = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "twin"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("length", "bucket", "sum(n) over (partition by length order by bucket rows between unbounded preceding and 1 preceding) as before")
    row = F.expr("row_number() over (partition by length, bucket order by doc_id, piece, ids_crc32, twin)")
    return keyed.withColumn("row", row).join(before, ["length", "bucket"]).withColumn("rank", F.col("row") - 1 + F.coalesce("before", F.lit(0))).drop("row", "before", "bucket")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECES with ``sequence_id`` and ``offset``: every piece of every row in a sequence of at
    most ``capacity`` tokens, without gaps.

    Null and empty texts have one piece (id 0). Repeated rows and null doc_ids are packed like
    any other. An empty table gives no rows; ties are broken by doc_id and piece, so
    reruns agree. Other columns are ignored."""
    spark = docs.sparkSession
    found = cut(pieces(docs, path, capacity))
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, capacity)
    slots = spark.createDataFrame(runs or [], "length long, first_rank long, last_rank long, per long, first_sequence long, first_offset long")
    slots = F.broadcast(slots) if len(runs) <= PLAN_ROWS else slots
    placed = ranked(found, sum(counts.values())).join(slots, "length").where("rank between first_rank and last_rank")
    return placed.selectExpr(
        "doc_id", "piece", "start", "length", "ids_crc32",
        "first_sequence + (rank - first_rank) div per as sequence_id",
        "first_offset + ((rank - first_rank) % per) * length as offset",
    )


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves. A sequence holds at most
    ``capacity`` tokens, so no group is unbounded. Rows of one doc_id must have one text; null and
    empty texts are an end each, an empty table gives no rows."""
    slots = pack(docs, path, capacity)
    ids = pieces(docs, path, capacity, with_ids=True).select("doc_id", "piece", "ids").dropDuplicates(["doc_id", "piece"])
    both = slots.join(ids, slots.doc_id.eqNullSafe(ids.doc_id) & (slots.piece == ids.piece)).select("sequence_id", "offset", "ids")
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
