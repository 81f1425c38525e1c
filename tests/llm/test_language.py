import random
import zlib

from docframe.llm import language as lang

WORDS = {
    "en": "the of and that with from have this which were their would about other there".split(),
    "de": "der die und das mit von haben dieser welche waren ihre würde über andere dort".split(),
    "fr": "le la et que avec depuis avoir cette lequel étaient leur serait environ autre là".split(),
}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(list(WORDS))
        made = [rng.choice(WORDS[name]) + rng.choice(["", "", "en", "tion"]) for _ in range(rng.randint(8, 200))]
        rows.append((i, " ".join(made), name if rng.random() < 0.9 else None, name))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    more = [(1000, None, "en", ""), (1001, "", None, ""), (1002, "123 --- 45", "de", ""), (1003, "²", None, ""), (None, "the of and that with from", "en", ""), (0, rows[0][1], rows[0][2], "")]
    docs = spark.createDataFrame([(d, t, lg, "s", 1.0) for d, t, lg, _ in rows + more], "doc_id long, text string, lang string, lang_pred string, score double").repartition(4)
    got = lang.identify(docs).collect()
    assert len(got) == len(rows) + len(more)
    truth = {d: name for d, _, _, name in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out]
    assert sum(right) / len(right) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002, 1003)} == {"und"}
    assert [r.lang_pred for r in got if r.doc_id is None] == ["en"]
    kept = lang.keep_identified(docs, lang.train(docs))
    assert kept.schema == docs.schema
    left = {r.doc_id for r in kept.collect()}
    assert not left & {1000, 1001, 1002, 1003} and len(left & set(truth)) > 0.97 * len(truth)


def test_predictions_ignore_labels_and_empty(spark):
    rows = [(i, t, name, "s") for i, t, name, _ in corpus(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = lang.train(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in lang.predict(docs, model).collect()}
    b = {r.doc_id - 5: (r.lang_pred, r.score) for r in lang.predict(docs.selectExpr("doc_id + 5 as doc_id", "text", "'xx' as lang"), model).collect()}
    assert a == b
    assert lang.identify(docs.limit(0)).count() == 0
    assert lang.predict(docs, lang.LanguageModel({})).where("lang_pred <> 'und'").count() == 0


def test_rejects_what_is_no_known_language():
    rng = random.Random(6)
    rows = corpus(200, seed=2)
    model = lang.LanguageModel({name: " ".join(t for _, t, _, true in rows if true == name)[:30_000].encode() for name in WORDS})
    rejected = lambda texts: sum(model.predict(t)[3] for t in texts) / len(texts)
    made = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))
    assert rejected([made("abcdefghijklmnopqrstuvwxyz", 200) for _ in range(50)]) > 0.8
    assert rejected([made("αβγδεζηθικλμνξοπρστυφχψω", 200) for _ in range(50)]) > 0.8
    clean = {name: [t for _, t, _, true in corpus(200, seed=3) if true == name] for name in WORDS}
    assert rejected([t for ts in clean.values() for t in ts]) == 0
    mixed = [f"{a} {b}" for a, b in zip(clean["en"], clean["fr"], strict=False)]
    margin = lambda texts: sum(model.predict(t)[2] for t in texts) / len(texts)
    assert margin(mixed) < 0.7 * margin(clean["en"])


def test_equals_plain_compression(spark):
    """Predictions of a table against one zstandard call a block and language, made here."""
    import math

    import zstandard

    rows = [(i, t, name) for i, t, name, _ in corpus(80, seed=5) if name] + [(500, "the of " * 3000, "en"), (501, "der", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang.train(docs)
    texts = {d: t for d, t, _ in rows}
    for r in lang.predict(docs, model).collect():
        plain, sizes = lang.normalised(texts[r.doc_id]), {}
        for name, data in model.dictionaries.items():
            options = zstandard.ZstdCompressionParameters.from_level(
                3, source_size=lang.BLOCK_CHARS, dict_size=len(data), min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=options)
            sizes[name] = sum(len(zstandard.ZstdCompressor(compression_params=options, dict_data=raw).compress(plain[i : i + lang.BLOCK_CHARS].encode())) for i in range(0, len(plain), lang.BLOCK_CHARS))
        least = min(sizes.values())
        ranked = sorted(sizes.values())
        assert sizes[r.lang_pred] == least
        assert abs(r.score - 1 / sum(math.exp((least - n) / lang.TEMPERATURE) for n in ranked)) < 1e-9
        if ranked[1] > least:
            assert abs(r.margin - (ranked[1] - least) / least) < 1e-12 and r.rejected == (r.margin < lang.MARGIN)
