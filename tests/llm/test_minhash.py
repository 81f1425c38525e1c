import random

import duckdb

from docframe.llm.minhash import SQL, near_duplicates, shingle_sets


def brute(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = [] if t is None else t.encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x = len(sets[a] & sets[b])
            if x and 100 * x >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                comp[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "ß"]
    rows, i = [], 0
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(1, 160))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            text = " ".join(copy)
            rows.append((i, text.upper() if r.random() < 0.2 else text))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "a b"), (i + 4, "A  B"), (i + 5, "a")]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n_shingles int, kept string").repartition(3)
    for words, percent in ((3, 85), (5, 80)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(docs, words, percent).collect()}
        assert got == brute(rows, words, percent)


def test_sql_twin_matches_brute_force():
    rows = corpus(2)
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    want = brute(rows, 3, 85)
    assert {r[0]: r[1:3] for r in db.execute(SQL).fetchall()} == want


def test_hot_group_and_repeats(spark):
    r = random.Random(3)
    base = [f"t{r.randrange(300)}" for _ in range(120)]
    rows = []
    for i in range(300):
        copy = list(base)
        for _ in range(i % 3):
            copy[r.randrange(120)] = f"z{r.randrange(9999)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    got = near_duplicates(docs, 3, 85).collect()
    assert len(got) == 301
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute(rows, 3, 85)


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=str) == sorted([(None, 2, None, True), (3, 2, 3, True)], key=str)


def test_tables_of_fewer_words_than_a_shingle(spark):
    for n in range(1, 5):
        members, sizes = shingle_sets([" ".join("abcd"[:n]).encode()], 5)
        assert len(members) == 1 and sizes.tolist() == [1]
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in near_duplicates(docs).collect()] == [(1, 1, 1, True)]
