"""Every registered query against its SQL twin, and what its plan must not hold."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docframe.operators import sets
from docframe.plans.catalogue import QUERIES, SQL
from docframe.plans.registry import Tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            out.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return out


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v if isinstance(v, (int, type(None))) else str(v)


def test_all_have_twins():
    assert set(QUERIES) == set(SQL) and len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    found = db.execute(SQL[name])
    names = [x[0] for x in found.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    want = sorted((tuple(plain(r[names.index(k)]) for k in cols) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[k]) for k in cols) for r in df.collect()), key=str) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


@pytest.mark.parametrize("nations", [[0, 1, 2], [1, 2], []])
def test_upsert_batch_of_id_0(spark, tmp_path, nations):
    """Several suppliers of nation 0, which is there or isn't."""
    spark.createDataFrame([(n, f"n{n}", 0) for n in nations], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(i, f"s{i}", n) for i, n in ((1, 0), (3, 0), (2, 0), (4, 2), (5, 7))], "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    small = duckdb.connect()
    for name in ("nation", "supplier"):
        small.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(small.execute(SQL["upsert_batch"]).fetchall())
    assert sorted(map(tuple, QUERIES["upsert_batch"](spark, str(tmp_path)).collect())) == want


def test_links_a_task_holds(spark, tmp_path, monkeypatch):
    """A task holds no more of the supplies where there are more of them, and all of them are there once."""
    monkeypatch.setattr(sets, "SHARE", 1 << 15, raising=False)
    most = {}
    for n in (5_000, 30_000):
        pairs = spark.range(n).select(F.expr("nullif(id % 7, 0)").alias("l_suppkey"), F.expr("xxhash64(id % 7, id div 14)").alias("l_partkey"))  # each twice
        pairs.coalesce(1).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        found = Tables(spark, f"{tmp_path}/{n}").frame("supplies")
        most[n] = max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
        assert found.columns == pairs.columns and sorted(map(str, found.collect())) == sorted({str(r) for r in pairs.collect()})
    assert most[30_000] < 2 * most[5_000]


def test_once_each_of_unknown_size(spark):
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(1, None), (1, None), (2, "b"), (None, "b"), (1, None)]), "a int, b string")
    assert sorted(map(tuple, sets.once_each(rows).collect()), key=str) == sorted([(1, None), (2, "b"), (None, "b")], key=str)
    assert sets.once_each(rows.limit(0)).collect() == []
