import random
from collections import defaultdict

import duckdb

from docframe.llm import lines as m


def brute(rows, ratio, least):
    pages = defaultdict(set)
    for _, t, s in rows:
        if t is not None:
            pages[s].add(t)
    drop = {}
    for s, ts in pages.items():
        n = defaultdict(int)
        for t in ts:
            for x in {y.strip(" ") for y in t.split("\n")} - {""}:
                n[x] += 1
        drop[s] = {x for x, c in n.items() if c >= least and c > ratio * len(ts)}
    out = []
    for d, t, s in rows:
        xs = [] if t is None else t.split("\n")
        kept = [x for x in xs if x.strip(" ") not in drop.get(s, ())]
        out.append((d, s, None if t is None else "\n".join(kept), len(xs), len(xs) - len(kept)))
    return out


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(400):
        s = rng.choice(["a", "b", "tiny" if i % 60 == 0 else "b", None])
        body = [f"line {rng.randint(0, 3000)}" for _ in range(rng.randint(0, 6))]
        if s == "a" and rng.random() < 0.3:
            body.insert(0, rng.choice(["© all rights", "  © all rights "]))
        if rng.random() < 0.12:
            body.append("menu | home")
        rows.append((i, "\n".join([*body, ""] if i % 5 == 0 else body), s))
    rows += [(1000 + i, "copied page\nwith two lines", "a") for i in range(150)]
    return rows + [(2000, None, "a"), (2001, "", "b"), (2002, "\n\n", None), (2003, "x", "only"), rows[3]]


def test_matches_brute_force_and_sql(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 5, "old") for r in rows], "doc_id long, text string, source string, n_lines int, extra string").repartition(4)
    out = m.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "source", "extra", "n_lines", "n_dropped"]
    got = sorted((tuple(r) for r in out.select("doc_id", "source", "text", "n_lines", "n_dropped").collect()), key=str)
    want = sorted(brute(rows, m.RATIO, m.LEAST), key=str)
    assert got == want and sum(r[4] for r in want) > 40
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", rows)
    assert sorted(db.execute(m.SQL).fetchall(), key=str) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.line_dedup(docs).count() == 0


def test_few_pages_and_names(spark):
    rows = [(1, "menu\nfirst", "small"), (2, "menu\nsecond", "small"), (3, "alone\ntext", "one"), (4, "alone\ntext", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    odd = docs.selectExpr("*", "1 as Source", "2 as __host", "3 as __lines", "4 as b_host", "5 as c1", "6 as N_LINES", "'x' as TEXT")
    out = m.line_dedup(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert sorted((r[0], r[1]) for r in out.collect()) == [(1, "first"), (2, "second"), (3, "alone\ntext"), (4, "alone\ntext")]
