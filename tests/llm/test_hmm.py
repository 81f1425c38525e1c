import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from docframe.llm import hmm


def small_model(rng, states=3, classes=5):
    made = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    return hmm.Model(rng.dirichlet(np.ones(states)), made(states, states), made(states, classes).T)


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 3, 6, 1)]
    for got, s in zip(hmm.log_likelihoods(model, seqs), seqs, strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = model.start[path[0]]
            for a, b in itertools.pairwise(path):
                p *= model.move[a, b]
            for k, x in zip(path, s, strict=True):
                p *= model.emit[x, k]
            total += p
        assert abs(got - math.log(total)) < 1e-9


def test_expected_counts_are_exact():
    rng = np.random.default_rng(2)
    model = small_model(rng)
    seqs = [rng.integers(0, 5, n) for n in (5, 2, 4, 1)]
    start, moves, counts, total = hmm.expected(model, seqs)
    s0, m0, c0 = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        ps, paths = [], list(itertools.product(range(3), repeat=len(s)))
        for path in paths:
            p = model.start[path[0]]
            for a, b in itertools.pairwise(path):
                p *= model.move[a, b]
            for k, x in zip(path, s, strict=True):
                p *= model.emit[x, k]
            ps.append(p)
        for p, path in zip(np.array(ps) / sum(ps), paths, strict=True):
            s0[path[0]] += p
            for a, b in itertools.pairwise(path):
                m0[a, b] += p
            for k, x in zip(path, s, strict=True):
                c0[x, k] += p
    assert np.allclose(start, s0, atol=1e-4) and np.allclose(moves, m0, atol=1e-4) and np.allclose(counts, c0, atol=1e-4)
    assert abs(total - hmm.log_likelihoods(model, seqs).sum()) < 1e-4


def corpus():
    rng = random.Random(5)
    pools = [[f"{p}{i}" for i in range(60)] for p in ("a", "xb", "Q", "é")]
    rows = []
    for i in range(400):
        pool = rng.choice(pools)
        rows.append((i, " ".join(rng.choice(pool) if rng.random() < 0.95 else f"u{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 7, 60, 400])))))
    return rows + [(900, None), (901, "  \n"), (902, "A0 a0"), rows[5], (None, "a1 a2")]


@pytest.mark.parametrize("listed", [1 << 18, 50])
def test_scores(spark, monkeypatch, listed):
    monkeypatch.setattr(hmm, "LISTED", listed)
    monkeypatch.setattr(hmm, "WARM_DOCS", 60)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, word string, score double").repartition(3)
    got = hmm.score(docs).collect()
    assert len(got) == len(rows)
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not out(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    texts = dict(rows)
    for r in got:
        ws = toks(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * max(1, abs(r.base_score))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)
    again = {(r.doc_id, round(r.score, 3)) for r in hmm.score(docs).collect()}
    assert again == {(r.doc_id, round(r.score, 3)) for r in got}


def test_classes_are_a_distribution():
    """Own words and, per shape, all known words and one unknown have probabilities that sum to one."""
    counts = {("a", 3): 5, ("b", 3): 2, ("c", 9): 1}
    norm = {s: 1 + sum(n + 1 for (_, t), n in counts.items() if t == s) for s in (3, 9)}
    for s in norm:
        assert abs(sum((n + 1) / norm[s] for (_, t), n in counts.items() if t == s) + 1 / norm[s] - 1) < 1e-12


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score(docs).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = hmm.score(spark.createDataFrame([(only, "a b")], docs.schema)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0
