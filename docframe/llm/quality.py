"""Quality scores by a generalised additive model with pairwise interactions.

Features of a text are counts over its bytes and words, computed for many texts at once with
array operations. Training goes round the features, fitting a shallow tree to the residuals over
each feature's bins in turn; then the pairs of features whose bins explain most of what is left
get trees over two features. All trees of a feature or pair add up to one lookup
table, so a score is a sum of table entries by bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import arrow_map, inputs, slices, SPACE, texts_of, word_hashes
from docframe.llm.folds import bounded_sample, held_out

#: Labelled rows of each label value that are drawn for training.
SAMPLE_ROWS = 20_000
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_ROUNDS, PENALTY = 32, 120, 0.15, 4, 6, 60, 2.0
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "upper", "digits", "spaces", "symbols", "pipes", "marks", "stops", "not_ascii",
    "distinct_words", "top_word", "line_bytes", "repeated_lines", "upper_starts", "next_equal", "symbol_ends",
)
SCORES = "doc_id long, score double"

_CLASSES = np.zeros((256, 9), np.int64)
for _i, _set in enumerate(
    (
        b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        b"0123456789",
        b" \t\n\r\x0b\x0c",
        b"#$%&*+<>@^_~=\\/{}[]`",
        b"|",
        b"!?",
        b".,;:",
        bytes(range(128, 256)),
    )
):
    _CLASSES[list(_set), _i] = 1


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for every text; all finite, and zeros (but for logs) for an empty one."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - 1, 1).astype(float)
    shares = np.stack([np.add.reduceat(_CLASSES[:, i][data], starts) for i in range(9)], 1).astype(float)
    shares[:, 3] -= 1  # the separator
    hashes, words = word_hashes(texts)
    ends = np.cumsum(words)
    w = np.maximum(words, 1).astype(float)
    space = SPACE[data]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
    upper = np.concatenate([[0], np.cumsum(_CLASSES[data[first], 1])])
    symbol = np.concatenate([[0], np.cumsum(_CLASSES[data[last], 4] + _CLASSES[data[last], 5])])
    same = np.concatenate([[0], np.cumsum(np.concatenate([[0], hashes[1:] == hashes[:-1]]))]) if len(hashes) else np.zeros(1, int)
    out = np.zeros((len(texts), len(FEATURES)))
    for i, (text, end, count) in enumerate(zip(texts, ends.tolist(), words.tolist(), strict=True)):
        if count:
            _, freq = np.unique(hashes[end - count : end], return_counts=True)
            lines = text.split(b"\n")
            out[i, 12] = len(freq) / count
            out[i, 13] = freq.max() / count
            out[i, 14] = len(text) / len(lines)
            out[i, 15] = 1 - len(set(lines)) / len(lines)
    out[:, 0], out[:, 1] = np.log1p(sizes - 1), np.log1p(words)
    out[:, 2] = (sizes - 1 - shares[:, 3]) / w
    for at, i in ((3, 0), (4, 1), (5, 2), (6, 3), (7, 4), (8, 5), (9, 6), (10, 7), (11, 8)):
        out[:, at] = shares[:, i] / n
    out[:, 16] = (upper[ends] - upper[ends - words]) / w
    inner = np.maximum(ends - words + 1, 0)
    out[:, 17] = np.where(words > 1, same[ends] - same[np.minimum(inner, ends)], 0) / w
    out[:, 18] = (symbol[ends] - symbol[ends - words]) / w
    return out


@dataclass
class Additive:
    """Edges of each feature's bins, a table for each feature, and for chosen pairs one over both bins."""

    base: float
    edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.base)
        for f in range(bins.shape[1]):
            out += self.tables[f][bins[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[bins[:, f], bins[:, g]]
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -500, 500)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree over one feature's bins, splits taken by greatest gain."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    spans = [(0, len(grad))]
    while len(spans) < leaves:
        best = (1e-6, None, 0)
        for a, b in spans:
            m = np.arange(a + 1, b)
            if len(m):
                win = _gain(g[m] - g[a], h[m] - h[a]) + _gain(g[b] - g[m], h[b] - h[m]) - _gain(g[b] - g[a], h[b] - h[a])
                i = int(np.argmax(win))
                if win[i] > best[0]:
                    best = (win[i], (a, b), int(m[i]))
        if best[1] is None:
            break
        a, b = best[1]
        spans.remove((a, b))
        spans += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in spans:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + PENALTY)
    return out


def _tree2(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """Values by both bins of the best tree with one cut on each feature, and its gain."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    parts = lambda s: (s, s[:, -1:] - s, s[-1:] - s, s[-1, -1] - s[:, -1:] - s[-1:] + s)
    quads = list(zip(parts(g), parts(h), strict=True))
    win = sum(_gain(a, b) for a, b in quads)
    i, j = np.unravel_index(np.argmax(win), win.shape)
    out = np.empty_like(g)
    values = [float(a[i, j] / (b[i, j] + PENALTY)) for a, b in quads]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out, float(win[i, j] - _gain(g[-1, -1], h[-1, -1]))


def _edges(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Distinct inner quantiles; plain ones where all rows weigh the same."""
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    if not len(values):
        return np.zeros(0)
    return np.unique(np.quantile(values, q) if (weight == weight[0]).all() else np.quantile(values, q, method="inverted_cdf", weights=weight))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Additive:
    """The model for rows ``x`` and labels ``y``, each standing for ``weight`` rows; without rows of both labels, a constant."""
    n = x.shape[1]
    weight = np.ones(len(y)) if weight is None else weight
    mean = ((weight * y).sum() + 0.5) / (weight.sum() + 1)
    edges = [_edges(x[:, f], weight) for f in range(n)]
    model = Additive(float(np.log(mean / (1 - mean))), edges, np.zeros((n, BINS)))
    if len(set(y.tolist())) < 2:
        return model
    bins, logit = model.bins(x), np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in range(n):
            grad, hess = slopes()
            tree = RATE * _tree(np.bincount(bins[:, f], grad, BINS), np.bincount(bins[:, f], hess, BINS), LEAVES)
            model.tables[f] += tree
            logit += tree[bins[:, f]]

    def grid(f: int, g: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(bins[:, f] * BINS + bins[:, g], values, BINS * BINS).reshape(BINS, BINS)

    grad, hess = slopes()
    ranked = sorted(((-_tree2(grid(f, g, grad), grid(f, g, hess))[1], f, g) for f in range(n) for g in range(f + 1, n)))
    model.pairs = [(f, g) for _, f, g in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((BINS, BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (f, g), table in zip(model.pairs, model.pair_tables, strict=True):
            grad, hess = slopes()
            tree = RATE * _tree2(grid(f, g, grad), grid(f, g, hess))[0]
            table += tree
            logit += tree[bins[:, f], bins[:, g]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, remainder: int = 0) -> Additive:
    """A model of the labelled rows outside the held-out fold. About SAMPLE_ROWS ids of each label value are
    drawn, so the ids that are broadcast and the features that reach the driver are bounded; they count for all
    rows of their label, so that a score means the same at every size.
    Null labels and ids don't count; of several labels of a document, each counts."""
    known = inputs(labels, **{"doc_id": "long", label: "int"}).toDF("doc_id", "label")
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, remainder))
    drawn = bounded_sample(known, "label", SAMPLE_ROWS)
    texts = inputs(docs, doc_id="long", text="string").join(F.broadcast(drawn), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = pa.array(list(features(texts_of(part))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("weight"), rows], ["doc_id", "label", "weight", "x"])

    rows = arrow_map(texts, run, "doc_id long, label int, weight double, x array<double>").toPandas().sort_values(["doc_id", "label"])
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["label"].to_numpy(float), rows["weight"].to_numpy(float))


def predict(docs: DataFrame, model: Additive) -> DataFrame:
    """SCORES per row of ``docs`` (doc_id, text): how likely the label is 1, from the whole text. Null texts count
    as empty and have a score too, null doc_ids stay, repeated rows have a row each and an
    empty table none; no other column is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value(features(texts_of(part))))], ["doc_id", "score"])

    return arrow_map(inputs(docs, doc_id="long", text="string"), run, SCORES)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, held_out, predicted`` by a model of the labels that aren't held out. Null ids are never held out and
    never learned from; without labels every score is 0.5. For null texts, repeats and empty tables see :func:`predict`."""
    scored = predict(docs, train(docs, labels))
    return scored.withColumn("held_out", held_out("doc_id", 5, 0)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
