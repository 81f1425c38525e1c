"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes all rows that its predecessor kept and returns the columns of documents, the last one
packed pieces. ``run`` writes every stage's rows to the shared scratch folder before the next reads them, so
a lost executor costs the stage at hand at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm.language import keep_identified, train
from docframe.llm.lines import line_dedup
from docframe.llm.minhash import near_duplicates
from docframe.llm.mixing import mix_rows
from docframe.llm.packing import pack
from docframe.session import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or without any evidence go."""
    return keep_identified(docs, train(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the boilerplate lines of their source; ``n_chars`` follows the text."""
    fresh = line_dedup(docs)
    out = fresh.select(*docs.columns, "n_dropped")
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 0.8), the one of smallest doc_id; of repeated
    rows of a doc_id one stays. Rows without a doc_id have no group and stay."""
    kept = near_duplicates(docs, words=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.select(*docs.columns).union(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, some repeatedly and some not at all, so that sources near their target weights."""
    return mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces with their place in a sequence."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: No SQL twin: language ID compresses texts, near-duplicates hash shingles, packing runs a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
