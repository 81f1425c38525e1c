"""Language identification by compression.

A model holds, per language, a raw-content zstandard dictionary of sampled training text. A text is
stripped to lower-case letters, cut in blocks that the dictionary still dominates, and
compressed with every dictionary; the language of fewest bytes wins. If the runner-up is too
close, the text is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import arrow_map, inputs, numbered, place, slices
from docframe.llm.folds import held_out

#: Size of a language's dictionary, filled with parts of so many characters that are drawn from all whole training texts; and
#: characters that are compressed at once.
DICTIONARY_BYTES, PART_CHARS, BLOCK_CHARS = 32 << 10, 120, 2_000
#: A text is rejected if the runner-up needs less than this share of bytes more. Of 998 held-out texts of sf0.1 that were right
#: the least margin is 0.014, and random letters mostly stay below 0.01.
MARGIN = 0.01
#: Bytes of advantage that make a language e times likelier, for the score.
TEMPERATURE = 3.0

PREDICTIONS = "doc_id long, lang_pred string, score double, margin double, rejected boolean"
_OTHER = re.compile(r"[\W\d_]+")


def normalised(text: str | None) -> str:
    """Lower-case words of letters only, or nothing if the text has no letter."""
    if not text:
        return ""
    plain = _OTHER.sub(" ", text.lower())
    return plain if any(map(str.isalpha, plain)) else ""


class LanguageModel:
    """Dictionaries by language; languages compare in code point order, so ties have one result."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.dictionaries = dict(sorted(dictionaries.items()))
        self._ready: list[tuple[str, zstandard.ZstdCompressor]] = []

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "_ready": []}

    def sizes(self, text: str) -> list[tuple[int, int, str]]:
        """(bytes, minus letters in words that the dictionary has, language), best first; words are
        looked up only where the bytes tie, which short texts do."""
        if not self._ready:
            for name, data in self.dictionaries.items():
                prepared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                # optimal parsing of matches from three bytes on: syllables count, not only words
                options = zstandard.ZstdCompressionParameters.from_level(
                    3, source_size=BLOCK_CHARS, dict_size=len(data), min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False
                )
                prepared.precompute_compress(compression_params=options)
                self._ready.append((name, zstandard.ZstdCompressor(compression_params=options, dict_data=prepared)))
        blocks = [text[i : i + BLOCK_CHARS].encode() for i in range(0, len(text), BLOCK_CHARS)]
        found = sorted((sum(len(c.compress(b)) for b in blocks), 0, name) for name, c in self._ready)
        tied = [x for x in found if x[0] == found[0][0]]
        if len(tied) > 1:
            words = [f" {w} ".encode() for w in text.split()]
            hits = sorted((n, -sum(len(w) for w in words if w in self.dictionaries[name]), name) for n, _, name in tied)
            found[: len(tied)] = hits
        return found

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected); ("und", 0, 0, True) without letters or languages."""
        plain = normalised(text)
        if not plain or not self.dictionaries:
            return "und", 0.0, 0.0, True
        sizes = self.sizes(plain)
        least = sizes[0][0]
        margin = 1.0
        if len(sizes) > 1:  # a tie that words break counts as half a byte
            margin = (sizes[1][0] - least + 0.5 * (sizes[1][0] == least and sizes[1][1] > sizes[0][1])) / least
        score = 1 / (1 + sum(math.exp(max(-700.0, (least - n) / TEMPERATURE)) for n, *_ in sizes[1:]))
        return sizes[0][2], score, margin, margin < MARGIN


def train(docs: DataFrame, folds: int = 5, remainder: int = 0) -> LanguageModel:
    """A model of ``docs`` (doc_id, text, lang) outside the held-out fold. Each part of PART_CHARS characters of
    each training text is as likely as any other of its language to be drawn, about twice as many as
    DICTIONARY_BYTES take; only they reach the driver. Null ids, texts and languages are left out; no
    rows give a model without languages. Reruns draw the same parts."""
    known = inputs(docs, doc_id="long", text="string", lang="string")
    known = known.where(~held_out("doc_id", folds, remainder) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chance = F.lit(0.0)
    for lang, chars in known.groupBy("lang").agg(F.sum(F.char_length("text"))).collect():
        chance = F.when(F.col("lang") == F.lit(lang), F.lit(min(1.0, 2 * DICTIONARY_BYTES / max(1, chars)))).otherwise(chance)
    draw = "pmod(xxhash64(doc_id, i, 'part'), 1152921504606846976L)"
    places = F.expr(f"filter(sequence(0, greatest(0, char_length(text) - 1) div {PART_CHARS}), i -> {draw} < chance * 1152921504606846976L)")
    parts = known.withColumn("chance", chance).select("lang", "doc_id", "text", F.explode(places).alias("i"))
    texts: dict[str, list] = {}
    for row in parts.selectExpr("lang", f"{draw} as draw", "doc_id", f"substring(text, i * {PART_CHARS} + 1, {PART_CHARS}) as part").collect():
        texts.setdefault(row.lang, []).append((row.draw, row.doc_id, row.part))
    out = {}
    for lang, found in texts.items():
        full = " ".join(dict.fromkeys(normalised(t).strip() for *_, t in sorted(found))).strip()
        if full:
            out[lang] = f" {full} ".encode()[:DICTIONARY_BYTES]
    return LanguageModel(out)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """PREDICTIONS per row of ``docs`` (doc_id, text), from the whole text. Null texts and texts
    without a letter are "und" with score 0. Null doc_ids stay, repeated rows have a row
    each, an empty table none; no other column is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = list(zip(*map(shared.value.predict, part.column("text").to_pylist()), strict=True)) or [()] * 4
                kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [x.split()[0] for x in PREDICTIONS.split(", ")])

    return arrow_map(inputs(docs, doc_id="long", text="string"), run, PREDICTIONS)


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` (text) whose language is not rejected, with all their columns, whatever their names. Null
    texts and texts without a letter go; repeated rows stay or go together; an empty table gives no rows."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), place(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not shared.value.predict(t)[3] for t in batch.column(at).to_pylist()], pa.bool_()))

    flat = numbered(docs)
    return arrow_map(flat, run, flat.schema).toDF(*docs.columns)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out`` and PREDICTIONS by a model of the rows that are not held out. Null ids are never held
    out and never learned from; for nulls, repeats and empty tables see :func:`predict`."""
    return predict(docs, train(docs)).withColumn("held_out", held_out("doc_id", 5, 0))
