"""Language-model scores by a hidden Markov model over word classes.

A word's class is its own for the OWN most frequent training words and the end of a text, and
otherwise one of SHAPES by its first and last bytes. Hidden states emit classes; within a class a
word has its share (c + 1) / (n + v + 1) of the class's n training tokens and v words, which
leaves one part for all unknown words as the unigram base does. Vocabulary counts cover all training
texts and stay distributed: the LISTED most frequent words are broadcast (16 bytes each), the
others are joined by hash. Baum-Welch runs over all training texts: each partition sends its
expected counts, which are summed by slot; a bounded sample only picks the starting point.
Scores come from the scaled forward recursion over whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import arrow_map, _BYTE, inputs, mix, slices, SPACE, texts_of, U, word_hashes
from docframe.llm.folds import held_out
from docframe.session import cut

STATES, OWN, SHAPES, LISTED = 8, 2048, 2048, 1 << 18
CLASSES = OWN + SHAPES
#: Passes of Baum-Welch over all training texts; passes over the sample that they start from, which is a stretch of up to
#: WARM_TOKENS tokens, at a place drawn by hash, of each of about WARM_DOCS texts.
PASSES, WARM_PASSES, WARM_DOCS, WARM_TOKENS = 3, 25, 400, 1_000
SMOOTH = 0.02
END = np.int64(0x5EED0E2D)
#: Tokens that a worker counts, or runs forward and backward over, at once, and whose moves it sums at once.
FLUSH, CHUNK = 1_000_000, 1 << 14

ENCODED = (
    "doc_id long, rid long, held_out boolean, classes binary, n_tokens long, n_known long, base_part double, class_part double, rare array<struct<word: long, n: int>>"
)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of every token, a text's end included, and the tokens of each text."""
    hashes, counts = word_hashes(texts)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    before = data[np.maximum(ends - 2, starts)]
    shape = mix(_BYTE[data[starts]] + _BYTE[data[ends - 1]] * U(3) + _BYTE[before] * U(5)) % U(SHAPES)
    at = np.cumsum(counts)
    return np.insert(hashes.view(np.int64), at, END), np.insert(shape.astype(np.int32), at, 0), counts + 1


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, shape, c``: counts of all tokens of ``docs`` (text). A null or empty text has one, its end; repeated
    rows count each, an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            words, at, n = np.unique(np.concatenate([h for h, _ in held]), return_index=True, return_counts=True)
            shapes = np.concatenate([s for _, s in held])[at]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(shapes), pa.array(n.astype(np.int64))], ["word", "shape", "c"])

        for batch in batches:
            for part in slices(batch):
                held.append(tokens_of(texts_of(part))[:2])
                if sum(len(h) for h, _ in held) > FLUSH:
                    yield flush()
        if held:
            yield flush()

    parts = arrow_map(inputs(docs, text="string"), run, "word long, shape int, c long")
    return parts.groupBy("word").agg(F.any_value("shape").alias("shape"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The listed words in order of their hash, and what holds for all words."""

    words: np.ndarray
    counts: np.ndarray
    own: np.ndarray  #: class of each listed word, or -1
    norms: np.ndarray  #: log10 of n + v + 1 of each shape
    total: int
    distinct: int


def lexicon(words: DataFrame) -> Lexicon:
    """From the vocabulary: sums, and its most frequent words. A histogram of the counts' magnitudes, at most a few hundred rows,
    gives the least count that LISTED words at most reach, so no more than those leave the executors."""
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = F.floor(F.log2("c") * 16).cast("int")
    hist = sorted(((r[0], r[1]) for r in words.groupBy(size).agg(F.count("*")).collect()), reverse=True)
    reach = np.cumsum([n for _, n in hist])
    least = hist[int((reach < LISTED).sum()) - 1][0] if len(hist) and reach[0] < LISTED else None
    listed = (F.col("word") == int(END)) if least is None else (F.col("word") == int(END)) | (size >= least)
    top = words.where(listed).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    other = top["word"].to_numpy() != END
    rank = np.cumsum(other)
    own = np.where(other & (rank < OWN), rank, -1)
    own[~other] = 0
    norms = np.ones(SHAPES)
    sizes = words.groupBy("shape").agg(F.sum(F.col("c") + 1).alias("n")).toPandas()
    norms[sizes["shape"].to_numpy(int)] += sizes["n"].to_numpy(float)
    inner = top[own >= 0]
    np.subtract.at(norms, inner["shape"].to_numpy(int), inner["c"].to_numpy(float) + 1)
    order = np.argsort(top["word"].to_numpy(np.int64))
    return Lexicon(top["word"].to_numpy(np.int64)[order], top["c"].to_numpy(np.int64)[order], own[order].astype(np.int64), np.log10(norms), int(total), int(distinct))


def encode(docs: DataFrame, known: Lexicon) -> DataFrame:
    """ENCODED per row: classes of its tokens and what listed words add to its scores; words that
    aren't listed are left to a join."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        logs = np.log10(lex.counts + 1.0)
        for batch in batches:
            for part in slices(batch):
                words, shapes, sizes = tokens_of(texts_of(part))
                at = np.minimum(np.searchsorted(lex.words, words), max(0, len(lex.words) - 1))
                listed = lex.words[at] == words if len(lex.words) else np.zeros(len(words), bool)
                own = np.where(listed, lex.own[at], -1) if len(lex.words) else np.full(len(words), -1)
                own[words == END] = 0
                classes = np.where(own >= 0, own, OWN + shapes).astype("<i2")
                log = np.where(listed, logs[at], 0.0) if len(lex.words) else np.zeros(len(words))
                starts = np.cumsum(sizes) - sizes
                base = np.add.reduceat(log, starts)
                inner = np.add.reduceat(np.where(own >= 0, 0.0, log - lex.norms[shapes]), starts)
                hits = np.add.reduceat(listed.astype(np.int64), starts)
                doc = np.repeat(np.arange(len(sizes)), sizes)[~listed]
                rare, index, n = np.unique(np.stack([doc, words[~listed]], 1), axis=0, return_index=True, return_counts=True) if len(doc) else (np.zeros((0, 2), np.int64), 0, np.zeros(0, int))
                pairs = pa.StructArray.from_arrays([pa.array(rare[:, 1]), pa.array(n.astype(np.int32))], ["word", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare[:, 0], np.arange(len(sizes) + 1)).astype(np.int32)), pairs)
                raw, cuts = classes.tobytes(), np.concatenate([[0], np.cumsum(sizes)]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "rid", "held_out")),
                        pa.array([raw[2 * a : 2 * b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                        *(pa.array(x) for x in (sizes, hits, base, inner)),
                        lists,
                    ],
                    ["doc_id", "rid", "held_out", "classes", "n_tokens", "n_known", "base_part", "class_part", "rare"],
                )

    return arrow_map(docs.select("doc_id", "rid", "held_out", "text"), run, ENCODED)


@dataclass
class Model:
    start: np.ndarray  #: (states)
    move: np.ndarray  #: (states, states)
    emit: np.ndarray  #: (classes, states)


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions, and the log-likelihood, of whole sequences, by forward and backward
    recursion in lockstep, the longest sequence first. Tokens are laid out step by step, so that
    what doesn't depend on another step is done for all steps at once."""
    states = len(model.start)
    ranked = sorted(sequences, key=lambda s: -len(s))
    lengths = np.array([len(s) for s in ranked])
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    offset = np.concatenate([[0], np.cumsum(active)])
    begin = np.cumsum(lengths) - lengths
    step = np.repeat(np.arange(steps), active)
    row = np.arange(offset[-1]) - offset[step]
    symbols = np.concatenate(ranked)[begin[row] + step]
    before = (offset[np.maximum(step - 1, 0)] + row)[active[0] :]  # of each token but first ones, the place of the token before it
    del step, row
    emit, move = model.emit.astype(np.float32)[symbols], model.move.astype(np.float32)
    alpha, scale = np.empty_like(emit), np.empty((len(symbols), 1), np.float32)
    places = offset.tolist()
    alpha[: places[1]] = model.start
    for t in range(steps):
        a, b = places[t], places[t + 1]
        now = alpha[a:b]
        if t:
            np.dot(alpha[places[t - 1] : places[t - 1] + b - a], move, out=now)
        now *= emit[a:b]
        total = scale[a:b]
        np.add.reduce(now, 1, out=total, keepdims=True)
        now /= total
    emit /= scale
    beta, turned = np.ones_like(emit), np.ascontiguousarray(move.T)
    for t in range(steps - 1, 0, -1):
        a, b, c = places[t - 1], places[t], places[t + 1]
        back = emit[b:c]
        back *= beta[b:c]
        np.dot(back, turned, out=beta[a : a + c - b])
    moves = np.zeros((states, states))
    for at in range(0, len(before), CHUNK):  # in parts, for the sums' precision
        moves += alpha[before[at : at + CHUNK]].T @ emit[active[0] + at : active[0] + at + CHUNK]
    alpha *= beta
    counts = np.stack([np.bincount(symbols, alpha[:, k], len(model.emit)) for k in range(states)], 1)
    return alpha[: active[0]].sum(0, dtype=float), moves * model.move, counts, float(np.log(scale).sum(dtype=float))


def maximised(start: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> Model:
    pi, move, emit = start + 1.0, moves + 1.0, counts + SMOOTH
    return Model(pi / pi.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def starting_point(sequences: list[np.ndarray], states: int = STATES) -> Model:
    """A model fitted to a small sample from a seeded guess that stays in its state."""
    rng = np.random.Generator(np.random.PCG64(11))
    counts = np.ones(CLASSES)
    for s in sequences:
        counts += np.bincount(s, minlength=CLASSES)
    move = np.full((states, states), 0.05 / states) + np.eye(states) * 0.95
    model = maximised(np.ones(states), move * 1e4, counts[:, None] * rng.uniform(0.2, 1.8, (CLASSES, states)))
    for _ in range(WARM_PASSES if sequences else 0):
        model = maximised(*expected(model, sequences)[:3])
    return model


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i2") for x in column.to_pylist()]


def train(encoded: DataFrame, states: int = STATES, passes: int = PASSES) -> Model:
    """Baum-Welch over all rows of ``encoded`` that aren't held out. Per pass, at most
    states * (classes + states + 1) sums reach the driver."""
    spark, texts = encoded.sparkSession, encoded.where("not held_out").select("classes")
    n = texts.count()
    drawn = encoded.where("not held_out").where(F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(1 << 60)) < (1 << 60) * min(1.0, WARM_DOCS / max(1, n)))
    first = f"cast(1 + 2 * pmod(xxhash64(doc_id, 'stretch'), greatest(1L, n_tokens - {WARM_TOKENS} + 1)) as int)"
    sample = drawn.selectExpr("doc_id", f"substring(classes, {first}, {2 * WARM_TOKENS}) as classes").orderBy("doc_id", "classes").collect()
    model = starting_point([np.frombuffer(r.classes, "<i2") for r in sample], states)
    cut_emit, cut_move = CLASSES * states, (CLASSES + states) * states
    for _ in range(passes if n else 0):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, held, size = np.zeros(cut_move + states), [], 0

            def add() -> None:
                if held:
                    start, moves, counts, _ = expected(shared.value, held)
                    total[:] += np.concatenate([counts.ravel(), moves.ravel(), start])
                    held.clear()

            for batch in batches:
                for s in _sequences(batch.column(0)):
                    held.append(s)
                    size += len(s)
                    if size > FLUSH:
                        add()
                        size = 0
            add()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "value"])

        sums = np.zeros(cut_move + states)
        found = arrow_map(texts, run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).toPandas()
        sums[found["slot"].to_numpy()] = found["value"].to_numpy()
        model = maximised(sums[cut_move:], sums[cut_emit:cut_move].reshape(states, states), sums[:cut_emit].reshape(CLASSES, states))
        shared.unpersist()
    return model


def log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole sequence, by the scaled forward recursion."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(-lengths, kind="stable")
    ranked = lengths[order]
    flat = np.concatenate(sequences).astype(np.int64)
    begin = (np.cumsum(lengths) - lengths)[order]
    steps = int(ranked[0])
    active = np.searchsorted(-ranked, -np.arange(1, steps + 1), side="right").tolist()
    out = np.zeros(len(sequences))
    now = np.repeat(model.start[None], len(sequences), 0)
    for t, n in enumerate(active):
        if t:
            now = now[:n] @ model.move
        now *= model.emit[flat[begin[:n] + t]]
        total = now.sum(1)
        out[:n] += np.log(total)
        now /= total[:, None]
    back = np.empty(len(sequences))
    back[order] = out
    return back


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``
    (doc_id, text), in log10.

    A null text counts as empty: its one token is the end. A null doc_id is never held out. Repeated
    rows count and score each by itself. Without training texts every word is unknown. An
    empty table gives no rows."""
    spark = docs.sparkSession
    rows = inputs(docs, doc_id="long", text="string").withColumn("held_out", held_out("doc_id", 7, 2))
    words = cut(vocabulary(rows.where("not held_out")))
    known = lexicon(words)
    encoded = cut(encode(rows.withColumn("rid", F.monotonically_increasing_id()), known))
    shared = spark.sparkContext.broadcast(train(encoded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "classes", 16 << 20):
                found = log_likelihoods(shared.value, _sequences(part.column("classes"))) / math.log(10)
                keep = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "classes"]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(found)], [c for c in part.schema.names if c != "classes"] + ["states_score"])

    kept = "doc_id long, rid long, held_out boolean, n_tokens long, n_known long, base_part double, class_part double, states_score double"
    scored = arrow_map(encoded.select("doc_id", "rid", "held_out", "classes", "n_tokens", "n_known", "base_part", "class_part"), run, kept)
    rare = encoded.select("rid", F.inline("rare"))
    rare = rare.join(words.select("word", "c"), "word", "left").groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    both = scored.join(rare, "rid", "left").withColumn("rare_log", F.coalesce("rare_log", F.lit(0.0)))
    norm = math.log10(known.total + known.distinct + 1)
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base_part") + F.col("rare_log") - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("states_score") + F.col("class_part") + F.col("rare_log")).alias("score"),
    )
