"""Registration of queries with their SQL twins, and the tables they run on."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from docframe.operators import sets
from docframe.plans.query import Query
from docframe.plans.relations import Navigator, RelationCatalog, ToMany, ToOne
from docframe.session import scratch_dir
from docframe.sources.database import Database

IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver's tables as queries, and the relations between them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def frame(self, name: str) -> DataFrame:
        if name == "supplies":  # which supplier delivers which part, as a link table
            return sets.once_each(self.frame("lineitem").select("l_suppkey", "l_partkey"))
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> Query:
        return Query(self.frame(name), id=IDS.get(name))

    @property
    def navigate(self) -> Navigator:
        relations = RelationCatalog()
        relations.add(ToOne("orders", "o_custkey", "customer", "c_custkey"))
        relations.add(ToOne("customer", "c_nationkey", "nation", "n_nationkey"))
        relations.add(ToOne("nation", "n_regionkey", "region", "r_regionkey"))
        relations.add(ToMany("customer", "orders", "orders", "o_orderkey", target_field="o_custkey"))
        relations.add(ToMany("orders", "lines", "lineitem", "l_linenumber", target_field="l_orderkey"))
        relations.add(ToMany("supplier", "parts", "part", "p_partkey", "supplies", "l_suppkey", "l_partkey"))
        return Navigator(relations, self.frame, IDS)


def stored(t: Tables, *names: str, directory: bool = False) -> Database:
    """A fresh database, in memory or a directory, with some of the tables as collections."""
    db = Database(t.spark, f"{scratch_dir(t.spark)}/db-{uuid.uuid4().hex}" if directory else f"memory:{uuid.uuid4().hex}")
    for name in names:
        db.attach(name, t.frame(name), IDS[name])
    return db


def rows_of(t: Tables, kind: str, rows: list[Any]) -> DataFrame:
    """What was answered on the driver, as a table."""
    return t.spark.createDataFrame([tuple(r) for r in rows], kind)


def query(sql: str | None = None) -> Callable:
    """Register a function of Tables under its name, with the SQL that has the same rows."""

    def add(f: Callable[[Tables], DataFrame | Query]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.df if isinstance(out, Query) else out

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
