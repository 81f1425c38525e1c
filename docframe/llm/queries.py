"""The operators as registered queries over their whole tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docframe.llm import hmm, lines, minhash
from docframe.llm.common import table
from docframe.llm.iblt import fingerprints
from docframe.llm.language import identify
from docframe.llm.media import clips, media_features, to_media
from docframe.llm.mixing import mix
from docframe.llm.packing import pack
from docframe.llm.quality import classify
from docframe.llm.secrets import span_digests


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed shots of every document stored as a video; nulls, repeats and empty tables as in :func:`clips`."""
    return clips(to_media(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_media": op2_media,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_language": op5_language,
    "op6_quality": op6_quality,
    "op7_iblt": op7_iblt,
    "op8_mixing": op8_mixing,
    "op9_lines": op9_lines,
    "op10_hmm": op10_hmm,
    "media_clips": media_clips,
}

SQL: dict[str, str] = {
    "op1_minhash": minhash.SQL,
    "op9_lines": lines.SQL,
}
