import base64
import hashlib
import random
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docframe.llm import iblt


def units(text):
    return {m.rstrip(" ") for m in re.findall(r"(?:[^ \n]+ *){1,%d}" % iblt.WORDS, text)}


def likeness(a, b):
    a, b = units(a), units(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(150):
        lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 60))) for _ in range(rng.choice([0, 1, 2, 5, 12]))]
        rows.append((i * 37 % 1009 + (10**12 if i % 7 == 0 else 0), "\n".join(lines) + rng.choice(["", "é", "\n"])))
    long = "\n".join(f"line {rng.randrange(10**6)} of many" for _ in range(900))
    return rows + [(-5, long), (-4, long[:-300] + "changed end"), (3000, None), (3001, ""), (3002, "x"), (3003, "x")]


@pytest.mark.parametrize("bucket", [500, 10])
def test_matches_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(iblt, "BUCKET_DOCS", bucket)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, digests string").repartition(3)
    got = {r.doc_id: r for r in iblt.fingerprints(docs).collect()}
    order = sorted((d, t or "") for d, t in rows)
    assert set(got) == {d for d, _ in order} and len(order) == len(rows)
    seen = {}
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - likeness(t, edited)) < 1e-12
        assert abs(r.near_next - likeness(t, following)) < 1e-12
        seen.setdefault(t, set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in seen.values()) and len({tuple(x) for x in seen.values()}) == len({frozenset(units(t)) for t in seen})


def decoded(text):
    """Block size (log2) and cells of a fingerprint."""
    bits, cells = text.split(":")
    raw = base64.b64decode(cells)
    return int(bits), {i: (n, k, c) for i, n, k, c in struct.iter_unpack(">iiqq", raw)}


def peel(cells, place, check):
    """Digests by sign from cells, or None; ``place`` and ``check`` hash a digest."""
    cells, found = dict(cells), {}
    while pure := [(n, k) for n, k, c in cells.values() if abs(n) == 1 and c == check(k)]:
        for n, k in set(pure):
            found[k] = n
            for i in place(k):
                m, x, c = cells.get(i, (0, 0, 0))
                cells[i] = (m - n, x ^ k, c ^ check(k))
    return found if not any(any(x) for x in cells.values()) else None


def test_likeness_follows_from_the_fingerprints(spark):
    """Both strings are read, the smaller sketch is made again in the larger one's size, they are subtracted and peeled."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    rows = {r.doc_id: r for r in iblt.fingerprints(docs).collect()}
    order = sorted(rows)
    known = set()
    for r in rows.values():
        for text in (r.fingerprint, r.edited_fingerprint):
            known |= {k for n, k, _ in decoded(text)[1].values() if n == 1}
    for _ in range(9):  # digests that come out of other cells only are hashed when they are found
        hashed = spark.createDataFrame([(k,) for k in known], "k long").selectExpr("k", "xxhash64(k, 77)", *(f"xxhash64(k, {b})" for b in range(3))).collect()
        table, missing = {r[0]: r[1:] for r in hashed}, set()

        def check(k):
            if k not in table:
                missing.add(k)
                return None
            return table[k][0]

        def place(k, bits):
            return [(b << bits) + (table[k][1 + b] & ((1 << bits) - 1)) for b in range(3)]

        def likeness_of(a, b):
            (p, left), (q, right) = decoded(a), decoded(b)
            one, two = peel(left, lambda k: place(k, p), check), peel(right, lambda k: place(k, q), check)
            if one is None or two is None:
                return None
            for bits in range(max(p, q), 30):
                cells = {}
                for mine, sign in ((one, 1), (two, -1)):
                    for k in mine:
                        for i in place(k, bits):
                            n, x, c = cells.get(i, (0, 0, 0))
                            cells[i] = (n + sign, x ^ k, c ^ table[k][0])
                if (out := peel(cells, lambda k, bits=bits: place(k, bits), check)) is not None:
                    return (len(one) + len(two) - len(out)) / (len(one) + len(two) + len(out)) if one or two else 1.0

        got = {d: (likeness_of(rows[d].fingerprint, rows[d].edited_fingerprint), likeness_of(rows[d].fingerprint, rows[order[(i + 1) % len(order)]].fingerprint)) for i, d in enumerate(order)}
        if not missing:
            break
        known |= missing
    assert all(abs(got[d][0] - rows[d].near_edited) < 1e-12 and abs(got[d][1] - rows[d].near_next) < 1e-12 for d in order)


@pytest.mark.parametrize("side", [16, 1])
def test_peeling_recovers_digests(spark, monkeypatch, side):
    """Also from sketches that are far too small at first."""
    monkeypatch.setattr(iblt, "SIDE", side)
    monkeypatch.setattr(iblt, "ROOM", 0.1)
    monkeypatch.setattr(iblt, "SPARE", 0)
    rows = [(i, "\n".join(f"p{j * i % 997}" for j in range(n))) for i, n in enumerate([0, 1, 2, 3, 5, 9, 40, 200, 700])]
    got = {r.doc_id: r for r in iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert abs(got[i].near_next - likeness(t, rows[(i + 1) % len(rows)][1])) < 1e-12


def test_one_id_for_many_rows(spark, monkeypatch):
    """Rows of one id, or of none, are parted by their text's hash, and still follow each other."""
    monkeypatch.setattr(iblt, "BUCKET_DOCS", 10)
    rows = [(7, f"a{i}\nb{i % 3}") for i in range(150)] + [(None, f"c{i}") for i in range(60)] + [(i, f"d{i}") for i in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordered, _ = iblt._in_order(docs)
    got = ordered.select("doc_id", "text", "next_text", "bucket").collect()
    sorted_rows = [r.text for r in docs.selectExpr("*", "shiftrightunsigned(xxhash64(text), 1) as h").orderBy(F.col("doc_id").asc_nulls_first(), "h", "text").collect()]
    follow = dict(zip(sorted_rows, sorted_rows[1:] + sorted_rows[:1], strict=True))
    assert len(got) == len(rows) and all(r.next_text == follow[r.text] for r in got)
    assert max(Counter(r.bucket for r in got).values()) < 60


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert iblt.fingerprints(docs).count() == 0
    one = iblt.fingerprints(spark.createDataFrame([(None, "a b")], docs.schema)).first()
    assert (one.n_chars, one.near_next) == (3, 1.0)
    twice = iblt.fingerprints(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], docs.schema)).collect()
    assert len(twice) == 3


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    plan = iblt.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
