import random
from collections import Counter, defaultdict

import corpus_pipeline as p
from docframe.llm import language, lines, mixing
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_packing import reference


def corpus():
    rng = random.Random(12)
    words = {"en": "the of and that with from".split(), "fr": "le la et que avec depuis".split()}
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "fr"])
        made = [" ".join(rng.choice(words[lang]) + rng.choice(["", "ing", "er", "x"]) for _ in range(rng.randint(6, 40))) for _ in range(rng.randint(1, 5))]
        source = rng.choice(["a", "b", "b", "b", None])
        if source == "b" and rng.random() < 0.4:
            made.append("All rights reserved.")
        rows.append((i, "\n".join(made), lang, source, 0))
    rows += [(200 + i, rows[i % 7][1] + (" end" if i % 2 else ""), rows[i % 7][2], "a", 0) for i in range(30)]
    return [*rows, (900, None, "en", "a", 0), (901, "12 34", None, "a", 0), (902, "", "fr", None, 0), rows[0], (None, rows[4][1], rows[4][2], "b", 0)]


def test_run_matches_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    stages, seen = [], docs
    for _, f in p.STAGES[:-1]:
        seen = p.cut(f(spark, seen, str(tmp_path)))
        assert seen.columns == docs.columns
        stages.append(seen.collect())
    model = language.train(docs)
    left = [r for r in rows if not model.predict(r[1])[3]]
    assert {r[0] for r in rows} - {r[0] for r in left} == {900, 901, 902}
    key = lambda xs: sorted(((x[0], x[1], x[3]) for x in xs), key=str)
    assert key(stages[0]) == key(left)
    left = [(d, t, None, s) for d, s, t, *_ in brute_lines([(d, t, s) for d, t, _, s, _ in left], lines.RATIO, lines.LEAST)]
    assert key(stages[1]) == key(left) and all(r.n_chars == len(r.text) for r in stages[1] if "All rights" in dict((x[0], x[1]) for x in rows)[r.doc_id] and "All rights" not in r.text)
    of = brute_near([(d, t) for d, t, *_ in left if d is not None], 5, 80)
    once = {(d, t, None, s) for d, t, _, s in left if d is None or of[d][1] == d}
    assert key(stages[2]) == key(once) and len(once) < 170
    taken = {r.doc_id: r for r in mixing.mix(spark.createDataFrame([(d, t, s) for d, t, _, s in once], "doc_id long, text string, source string")).collect()}
    many = [x for x in once for _ in range(int(taken[x[0]].taken / taken[x[0]].size + 0.5) if taken[x[0]].size else 0)]
    assert key(stages[3]) == key(many)
    encode = reference()
    want = Counter((d, len(encode(t or "")) + 1) for d, t, *_ in many)
    out = p.run(spark, str(tmp_path)).collect()
    got, ends = defaultdict(int), defaultdict(int)
    for r in out:
        got[r.doc_id] += r.length
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    per = defaultdict(int)
    for (d, n), times in want.items():
        per[d] += n * times
    assert dict(got) == dict(per) and sum(ends.values()) == sum(per.values()) and max(ends.values()) <= 2048


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
