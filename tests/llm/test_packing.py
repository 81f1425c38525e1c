import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docframe.llm import packing as p

pytest.importorskip("public_tokenizers")


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.default_tokenizer())
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_texts_that_spell_added_tokens():
    for text in ("hello <|endoftext|> world", "a<|EndOfText|>b", "x <|startoftext|>", "<|endoftext|", "é<|endoftext|>"):
        assert np.frombuffer(p.tokenizer(p.default_tokenizer())([text])[0], "<u4").tolist() == reference()(text)
    assert reference()("hello <|endoftext|> world") == [3306, 49407, 1002]


TEXT = st.text(st.one_of(st.sampled_from("abcXYZ 's'tre_12.,!\n\t|%éÈßñç²½ \x1c\x85İΣσςﬁ—’…"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_tokenizer_equals_library(text):
    assert np.frombuffer(p.tokenizer(p.default_tokenizer())([text])[0], "<u4").tolist() == reference()(text)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=20))
def test_plan_is_gapless(counts):
    taken, ranks = defaultdict(list), defaultdict(list)
    for length, lo, hi, per, first, offset in p.plan(counts, 50):
        for r in range(lo, hi + 1):
            ranks[length].append(r)
            taken[first + (r - lo) // per].append((offset + (r - lo) % per * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    for slots in taken.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 50
    rooms = []  # best fit, longest first, one piece at a time
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is None:
            rooms.append(50 - length)
        else:
            rooms.remove(fit)
            rooms.append(fit - length)
    assert len(taken) == len(rooms)


def test_packs_all_pieces(spark, monkeypatch):
    monkeypatch.setattr(p, "BUCKET", 30)
    rng = random.Random(2)
    words = ["the", "Ouch", "a1", "x's", "é", "tiontion", "&&&", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 300, 2600])))) for i in range(120)]
    rows += [(500, None), (501, ""), rows[0], (None, "the")]
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, length int, rank string").repartition(3)
    got = p.pack(docs).collect()
    encode, want = reference(), []
    for d, t in rows:
        ids = [*encode(t or ""), 0]
        for i, at in enumerate(range(0, len(ids), 2048)):
            one = ids[at : at + 2048]
            want.append((d, i, at, len(one), zlib.crc32(np.array(one, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    slots = defaultdict(list)
    for r in got:
        slots[r.sequence_id].append((r.offset, r.length))
    for s in slots.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(slots) <= sum(w[3] for w in want) / 2048 * 1.05 + 2
    assert {tuple(r) for r in p.pack(docs).collect()} == {tuple(r) for r in got}
    made = {r.sequence_id: len(r.ids) for r in p.sequences(docs).collect()}
    assert made == {k: sum(n for _, n in v) for k, v in slots.items()}
    assert p.pack(docs.limit(0)).count() == 0
