"""Files that other systems wrote, as collections' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_documents(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; without a schema as (Value variant), so nothing is scanned to infer one."""
    if schema is not None:
        return spark.read.schema(schema).json(path)
    return spark.read.text(path).select(F.try_parse_json("value").alias("Value"))


def csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=header)


def constants(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of files in a directory, for the file store."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
