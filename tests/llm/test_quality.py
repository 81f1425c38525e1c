import random
import zlib

import numpy as np

from docframe.llm import quality as q


def corpus(n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["the", "of", "and", "with"]) + rng.choice(["", "ing", "ed"]) for _ in range(rng.randint(3, 120))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            words = [w + rng.choice("#$%&") * 3 for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else " | ".join(words).split()
        rows.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, int(good)))
    return rows, labels


def test_features_are_finite_and_batch_free():
    texts = [b"", b" ", b"\n", b"a", "é| B!! 12\n\nB".encode(), b"x" * 5000, b"same same same\nsame"]
    whole = q.features(texts)
    assert np.isfinite(whole).all() and whole.shape == (7, len(q.FEATURES))
    for t, row in zip(texts, whole, strict=True):
        assert np.allclose(q.features([t])[0], row)
    f = dict(zip(q.FEATURES, whole[6], strict=True))
    assert (f["distinct_words"], f["top_word"], f["next_equal"]) == (0.25, 1.0, 0.75)


def test_pairs_learn_interactions():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = q.fit(x, y)
    assert (0, 1) in model.pairs and ((model(x) > 0.5) == y).mean() > 0.95
    assert q.fit(x, np.ones(4000))(x).min() > 0.9


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    more = [(9000, None), (9001, ""), (None, "the of"), rows[1]]
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows + more], "doc_id long, text string, label int, score double").repartition(3)
    marks = spark.createDataFrame([*((d, v, 0) for d, v in labels), (5, None, 1), (None, 1, 1), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    got = q.classify(docs, marks).collect()
    assert len(got) == len(rows) + len(more)
    truth = dict(labels)
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert sum(held) / len(held) > 0.95
    assert q.classify(docs.limit(0), marks).count() == 0
    assert q.classify(docs, marks.limit(0)).where("score is null").count() == 0


def test_scores_do_not_depend_on_the_sampled_ratio(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.uniform(size=(30_000, 3)), (rng.uniform(size=30_000) < 0.86).astype(float)
    taken = (y == 0) | (rng.uniform(size=30_000) < 0.16)
    part = q.fit(x[taken], y[taken], np.where(y[taken] == 1, 1 / 0.16, 1.0))
    assert abs(part.base - q.fit(x, y).base) < 0.1 and abs(part(x).mean() - 0.86) < 0.02
    monkeypatch.setattr(q, "SAMPLE_ROWS", 100)
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 7 > 0 as int) as quality")
    model = q.train(spark.range(3000).selectExpr("id as doc_id", "'same words in all' as text"), labels)
    assert abs(model.base - np.log(6)) < 0.4
