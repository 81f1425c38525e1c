"""One text beyond every slice and batch limit, and texts without any white space or line end, through all operators."""

import hashlib
import random

import pytest

from docframe.llm import hmm, iblt, language, lines, media, minhash, mixing, packing, quality, secrets
from docframe.llm.common import SLICE_BYTES


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}é" for _ in range(190_000)]
    long = "\n".join(" ".join(words[i : i + 40]) for i in range(0, len(words), 40))
    assert len(long.encode()) > SLICE_BYTES
    rows = [(1, long, "en", "a"), (2, "x" * 400_000, "en", "a"), (3, long[:-40] + " another end", "en", "b"), (4, "short text", "fr", "b"), (5, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1), dict((r[0], r[1]) for r in rows)


def test_minhash(docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs[0], 3, 85).collect()}
    words = docs[1][1].split()
    assert got[1].n_shingles == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})
    assert [got[i].component_id for i in (1, 2, 3, 4, 5)] == [1, 2, 1, 4, 5]


def test_media(docs):
    got = {r.doc_id: r for r in media.media_features(docs[0]).collect()}
    data = docs[1][1].encode()
    assert got[1].n_bytes == len(data) and got[1].payload_sha256 == hashlib.sha256(media.padded(data)).hexdigest()


def test_packing(docs):
    got = packing.pack(docs[0]).collect()
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    encode = packing.tokenizer(packing.default_tokenizer()).model.encode
    assert total == {d: len(encode(t or "", add_special_tokens=False).ids) + 1 for d, t in docs[1].items()}


def test_lines_mixing_fingerprints(docs):
    assert {r.doc_id: r.n_lines for r in lines.line_dedup(docs[0]).collect()} == {d: 0 if t is None else t.count("\n") + 1 for d, t in docs[1].items()}
    assert {r.doc_id: r.size for r in mixing.mix(docs[0]).collect()} == {d: len((t or "").split()) for d, t in docs[1].items()}
    got = {r.doc_id: r for r in iblt.fingerprints(docs[0]).collect()}
    assert 0.2 < got[1].near_edited < 0.5 and got[1].n_chars == len(docs[1][1]) and got[5].near_next == 0


def test_models(docs):
    scored = {r.doc_id: r for r in hmm.score(docs[0]).collect()}
    assert {d: r.n_tokens for d, r in scored.items()} == {d: len((t or "").split()) + 1 for d, t in docs[1].items()}
    assert all(r.score < 0 and r.score == r.score for r in scored.values())
    assert language.identify(docs[0]).where("lang_pred = 'und'").count() == 1
    labels = docs[0].selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    assert quality.classify(docs[0], labels).where("score between 0 and 1").count() == 5


def test_secrets(docs):
    assert {r.doc_id: r.n_hex for r in secrets.span_digests(docs[0]).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0}
