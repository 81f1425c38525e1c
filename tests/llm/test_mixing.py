import math
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docframe.llm import mixing as m


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=2)), st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    got = m.targets(sizes)
    assert set(got) == set(sizes)
    assert all(got[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 * max(1, sum(sizes.values()))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_ = [s for s in sizes if got[s] < 3 * sizes[s] - 1e-6]
    assert len({round(got[s] / weight[s], 4) for s in open_}) <= 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=12), st.integers(0, 300))
def test_apportion_is_by_highest_quotients(votes, seats):
    want = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[best] += 1
    assert m.apportion([float(v) for v in votes], seats) == want


def corpus():
    rng = random.Random(6)
    names = ["a", "b", "c", "é", None, "hot"]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 50, 300]))), "hot" if rng.random() < 0.6 else rng.choice(names)) for i in range(900)]
    return rows + [(5000, None, "a"), (5001, "\t \n", "b"), rows[3], rows[3], (None, "x y z", "c")]


def test_takes_near_targets(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_DOCS", 60)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, taken int, target double")
    got = m.mix(docs.repartition(5)).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    assert len(got) == len(rows)
    totals, taken = defaultdict(int), defaultdict(int)
    words = {d: len((t or "").encode().split()) for d, t, _ in rows}
    for d, _, s in rows:
        totals[s] += words[d]
    goal = m.targets(totals)
    for r in got:
        source = "c" if r.doc_id is None else r.source
        assert (r.size, r.source_size) == (words[r.doc_id], totals[source])
        assert abs(r.target - goal[source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s, t in goal.items():
        assert abs(taken[s] - t) <= m.BLOCK * 2 + 0.01 * t, s
    key = lambda xs: sorted(((r.doc_id, r.size, r.target, r.taken) for r in xs), key=str)
    assert key(got) == key(m.mix(docs.repartition(2, "text")).collect())


def brute(rows, draws, seats, targets, block):
    """The mix in plain Python, from each row's draw and the sources' seats."""
    out = []
    sizes = [len((t or "").encode().split()) for _, t, _ in rows]
    alike = defaultdict(list)
    for i, r in enumerate(rows):
        alike[r[0], draws[i], sizes[i], r[2]].append(i)
    firsts = {v[0]: len(v) for v in alike.values()}
    for s in targets:
        mine = [i for i, r in enumerate(rows) if r[2] == s and i in firsts]
        n_shards = -(-len(mine) // max(m.SHARD_DOCS, math.isqrt(4 * len(mine))))
        shards = defaultdict(list)
        for i in mine:
            shards[draws[i] % n_shards].append(i)
        words = {k: sum(sizes[i] * firsts[i] for i in v) for k, v in shards.items()}
        total = sum(words.values())
        quota = {k: math.floor(seats[s] * w / total + 0.5) if total else 0 for k, w in words.items()}
        miss = seats[s] - sum(quota.values())
        gain = sorted(words, key=lambda k: (-words[k] / (2 * quota[k] + 1), k))[: max(0, miss)]
        lose = sorted((k for k in words if quota[k]), key=lambda k: (words[k] / (2 * quota[k] - 1), -k))[: max(0, -miss)]
        for k in gain:
            quota[k] += 1
        for k in lose:
            quota[k] -= 1
        for k, v in shards.items():
            left, w = min(quota[k] * block, 3 * words[k]), words[k]
            passes, rest = (left // w, left % w) if w else (0, 0)
            for i in sorted(v, key=lambda i: (draws[i], str(rows[i][0]), sizes[i])):
                n = firsts[i]
                part = min(sizes[i] * n, rest)
                whole = passes * sizes[i] * n + part
                out += [(rows[i][0], sizes[i], whole // n + (j < whole % n)) for j in range(n)]
                rest -= part
    return sorted(out, key=str)


def test_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_DOCS", 60)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    draws = [r.d for r in docs.select(F.xxhash64(F.lit(m.SEED), "doc_id", "text").alias("d")).collect()]
    totals = defaultdict(int)
    for _, t, s in rows:
        totals[s] += len((t or "").encode().split())
    goal = m.targets(totals)
    names, block = list(goal), m.block_size(goal)
    seats = dict(zip(names, m.apportion([goal[s] for s in names], round(sum(goal.values()) / block)), strict=True))
    got = sorted(((r.doc_id, r.size, r.taken) for r in m.mix(docs.repartition(3)).collect()), key=str)
    assert got == brute(rows, draws, seats, goal, block)


def test_rows_and_empty(spark):
    rows = corpus()[:900]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = m.mix_rows(docs)
    assert out.schema == docs.schema
    n = sum(len(t.split()) for _, t, _ in rows)
    mixed = out.collect()
    assert abs(sum(len(r.text.split()) for r in mixed) - n) < 0.1 * n
    assert m.mix(docs.limit(0)).count() == 0 and m.mix_rows(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], docs.schema)
    assert [r.taken for r in m.mix(blank).collect()] == [0, 0]


def test_small_sources_and_tables(spark):
    kind = "doc_id long, text string, source string"
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(500), "b") for i in range(20)] + [(100, text(6), "a"), (101, text(2), None)]
    got = {}
    for r in m.mix(spark.createDataFrame(rows, kind)).collect():
        got[r.source_size] = (r.target, got.get(r.source_size, (0, 0))[1] + r.taken)
    for size, (target, taken) in got.items():
        assert abs(taken - target) <= max(1, 0.04 * target), size
    few = spark.createDataFrame([(1, text(9), "a"), (2, text(9), "b"), (3, text(9), "c")], kind)
    assert sum(r.taken for r in m.mix(few).collect()) == 27
    two = spark.createDataFrame([(1, text(9), "a"), (2, text(8), "b")], kind)
    assert {r.doc_id for r in m.mix_rows(two).collect()} == {1, 2}


def test_rows_alike_and_names(spark, monkeypatch):
    monkeypatch.setattr(m, "TOGETHER", 7)
    rows = [(1, "a b c", "x", i) for i in range(50)] + [(1, "d e f g", "y", 0), (None, "h i", "x", 0), (None, "j", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    got = m.mix(docs).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == sum(len(r[1].split()) for r in rows)
    assert len({r.taken for r in got if r["size"] == 3}) <= 2
    odd = docs.toDF("doc_id", "text", "source", "Source").selectExpr("*", "1 as __id", "2 as __taken", "3 as size", "4 as draw", "5 as s_times", "6 as c0")
    mixed = m.mix_rows(odd)
    assert mixed.columns == odd.columns and {r[1] for r in mixed.collect()} >= {"a b c"}
