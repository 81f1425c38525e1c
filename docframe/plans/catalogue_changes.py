"""Registered queries that run databases, collections, handlers, files and the façade, and show what they leave."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docframe import errors
from docframe.functions import nested, temporal
from docframe.functions import registry as functions
from docframe.plans.query import Query
from docframe.plans.registry import Tables, query, rows_of, stored
from docframe.plans.relations import RelationCatalog, ToMany, ToOne
from docframe.session import scratch_dir
from docframe.sources import mongo
from docframe.sources.database import Database
from docframe.sources.files import CHUNK, FileStore
from docframe.streaming.events import stream_into
from docframe.types import polymorphic, schema

c = F.col
CUSTOMER_NATION = ToOne("customer", "c_nationkey", "nation", "n_nationkey", on_delete="cascade")
NATION_REGION = ToOne("nation", "n_regionkey", "region", "r_regionkey", on_delete="cascade")
NODE = schema({"Name": "string", "Next": "ref"})


def refused(f, *kinds: type) -> str:
    """The name of the error that ``f`` raises; "none" if it raises none of ``kinds``."""
    try:
        f()
    except kinds or (errors.DocframeError,) as error:
        return type(error).__name__
    return "none"


def supplied(t: Tables) -> Database:
    """Suppliers and parts with the link table between them."""
    db = stored(t, "supplier", "part")
    db.attach("supplies", t.frame("supplies"), "l_suppkey")
    db.relate(ToMany("supplier", "parts", "part", "p_partkey", "supplies", "l_suppkey", "l_partkey"))
    return db


# -- databases and collections


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def open_database(t: Tables):
    db = stored(t, "nation", directory=True)
    db.collection("nation").delete(3)
    again = Database(t.spark, db.source)
    again.collection("nation").insert_batch(t.frame("region").selectExpr("r_regionkey + 100 AS n_nationkey", "r_name AS n_name"))
    return db.collection("nation").df.select("n_nationkey", "n_name")


@query("SELECT Id, a, b FROM (VALUES (1, 1, 'x'), (2, NULL, NULL), (3, 7, NULL)) v(Id, a, b)")
def untyped_collection(t: Tables):
    docs = stored(t).untyped("Docs")
    docs.insert_batch([{"Value": json.dumps(v)} for v in ({"a": 1, "b": "x"}, "text", {"a": 7})])
    return docs.df.select("Id", nested.dyn(c("Value"), "a", "int").alias("a"), nested.dyn(c("Value"), "b", "string").alias("b"))


@query("SELECT name FROM (VALUES ('nation'), ('region')) v(name)")
def collection_admin(t: Tables):
    db = stored(t, "nation", "region", "supplier")
    db.drop("supplier")
    db.drop("nothing", missing_ok=True)
    return rows_of(t, "name string", [(n,) for n in db.names() if db.exists(n)])


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey <> 5")
def backup_and_upkeep(t: Tables):
    db = stored(t, "supplier", directory=True)
    db.collection("supplier").ensure_index("s_name")
    db.collection("supplier").delete_many(c("s_nationkey") == 5)
    db.optimize()
    db.vacuum()
    db.backup(f"{db.source}-copy")
    return Database(t.spark, f"{db.source}-copy").collection("supplier").df.select("s_suppkey", "s_name")


@query("SELECT count(*) AS n, round(sum(s_acctbal), 2) AS s FROM supplier WHERE s_nationkey > 4")
def cached_collection(t: Tables):
    db = stored(t, "supplier")
    db.enable_caching()
    rows = db.collection("supplier").query().where(c("s_nationkey") > 4)
    found = (rows.count(), round(rows.sum("s_acctbal"), 2))
    db.disable_caching()
    return rows_of(t, "n long, s double", [found])


@query("SELECT n_nationkey, n_name FROM nation")
def layout_migration(t: Tables):
    """A directory of the layout before the present one."""
    db = stored(t, "nation", directory=True)
    old = {"layout": 2, "tables": {"nation": db._section("tables")["nation"][0]}, "indexes": {"nation": {"n_name": True}}}
    for number in db.storage._numbers():
        db.storage.fs.delete(db.storage._path(f"manifest-{number:012d}.json"), False)
    stream = db.storage.fs.create(db.storage._path("manifest.json"))
    stream.write(bytearray(json.dumps(old).encode()))
    stream.close()
    again = Database(t.spark, db.source).collection("nation", id="n_nationkey")
    assert again._unique() == [("n_name",)]
    return again.df.select("n_nationkey", "n_name")


# -- raw SQL


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 2 THEN 0 ELSE round(s_acctbal, 2) END AS b FROM supplier WHERE s_nationkey <> 4 UNION ALL SELECT n_nationkey + 100000, 1 FROM nation")
def raw_execute(t: Tables):
    db = stored(t, "supplier", "nation")
    db.execute("UPDATE supplier SET s_acctbal = :b WHERE s_nationkey = :n", b=0.0, n=2)
    db.execute("DELETE FROM supplier WHERE s_nationkey = :n", n=4)
    db.execute("INSERT INTO supplier (s_suppkey, s_acctbal) SELECT n_nationkey + 100000, 1 FROM nation")
    return db.collection("supplier").df.select("s_suppkey", F.round("s_acctbal", 2).alias("b"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def raw_multi_map(t: Tables):
    db = stored(t, "supplier", "nation", "region")
    text = "SELECT s.*, n.*, r.* FROM supplier s JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey"
    return db.sql_map(text, "n_nationkey", "r_regionkey").select("_1.s_suppkey", "_2.n_name", "_3.r_name")


# -- inserts, replacements, updates


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT max(n_nationkey) + 1, 'ATLANTIS' FROM nation")
def insert_one(t: Tables):
    nations = stored(t, "nation").collection("nation")
    nations.insert({"n_name": "ATLANTIS"})
    return nations.df.select("n_nationkey", "n_name")


@query("SELECT pos, id FROM (VALUES (0, 50), (1, 51), (2, 7), (3, 52)) v(pos, id)")
def insert_batch_ids(t: Tables):
    ids = stored(t, "region").collection("region").insert_batch([{"r_regionkey": 50, "r_name": "a"}, {"r_name": "b"}, {"r_regionkey": 7}, {"r_name": "d"}])
    return rows_of(t, "pos int, id int", list(enumerate(ids)))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT s_suppkey + 1000, s_name FROM supplier")
def insert_rows(t: Tables):
    nations = stored(t, "nation", directory=True).collection("nation")
    nations.insert_batch(t.frame("supplier").selectExpr("s_suppkey + 1000 AS n_nationkey", "s_name AS n_name"))
    return nations.df.select("n_nationkey", "n_name")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'FOUR' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 99, 'NEW'")
def upsert_one(t: Tables):
    nations = stored(t, "nation").collection("nation")
    nations.upsert({"n_nationkey": 4, "n_name": "FOUR"})
    nations.upsert({"n_nationkey": 99, "n_name": "NEW"})
    return nations.df.select("n_nationkey", "n_name")


@query(
    """SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL
       SELECT s_nationkey, max_by(s_name, s_suppkey) FROM supplier GROUP BY s_nationkey"""
)
def upsert_batch(t: Tables):
    nations = stored(t, "nation").collection("nation")
    nations.upsert_batch(t.frame("supplier").selectExpr("s_nationkey AS n_nationkey", "s_name AS n_name", "s_suppkey"), last_wins=c("s_suppkey"))
    return nations.df.select("n_nationkey", "n_name")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'FAR EAST' ELSE r_name END AS r_name, 'KeyNotFound' AS missing FROM region")
def update_one(t: Tables):
    regions = stored(t, "region").collection("region")
    regions.update({"r_regionkey": 2, "r_name": "FAR EAST"})
    missing = refused(lambda: regions.update({"r_regionkey": 77, "r_name": "x"}))
    return regions.df.select("r_regionkey", "r_name", F.lit(missing).alias("missing"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 'F-done' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_many_set(t: Tables):
    orders = stored(t, "orders").collection("orders")
    orders.update_many(c("o_orderstatus") == "P", {"o_orderstatus": F.lit("F")}, {"o_orderpriority": F.concat("o_orderstatus", F.lit("-done"))})
    return orders.df.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT vec_id, CASE WHEN label = 1 THEN '2,1,9' ELSE '1,2' END AS tags FROM embeddings")
def update_arrays(t: Tables):
    db = stored(t)
    vectors = db.attach("vectors", t.frame("embeddings").select("vec_id", "label", F.array(F.lit(1), F.lit(2)).alias("tags")), "vec_id")
    tags = c("tags")
    vectors.update_many(c("label") == 1, {"tags": nested.append(tags, 9)}, {"tags": nested.insert_at(tags, 0, 2)}, {"tags": nested.remove_at(tags, 2)})
    return vectors.df.select("vec_id", F.array_join(c("tags").cast("array<string>"), ",").alias("tags"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'gone' ELSE s_name END AS s_name, CASE WHEN s_nationkey = 3 THEN 0 ELSE round(s_acctbal, 2) END AS s_acctbal FROM supplier")
def replace_many(t: Tables):
    suppliers = stored(t, "supplier").collection("supplier")
    suppliers.replace_many(c("s_nationkey") == 3, {"s_name": "gone", "s_acctbal": 0.0})
    return suppliers.df.select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal > 0) THEN 'first' ELSE s_name END AS s_name FROM supplier")
def replace_one(t: Tables):
    suppliers = stored(t, "supplier").collection("supplier")
    suppliers.replace_one(c("s_acctbal") > 0, {"s_name": "first"})
    return suppliers.df.select("s_suppkey", "s_name")


@query("SELECT step, outcome FROM (VALUES (1, 'none'), (2, 'VersionConflict'), (3, 'NotSupported')) v(step, outcome)")
def version_check(t: Tables):
    col = stored(t).collection("Account", schema({"Balance": "float64", "Version": "int64"}))
    col.insert({"Balance": 1.0, "Version": 1})
    change = lambda v: lambda: col.update({"Id": 1, "Balance": 2.0, "Version": v + 1}, version=v, version_field="Version")
    return rows_of(t, "step int, outcome string", [(1, refused(change(1))), (2, refused(change(1))), (3, refused(lambda: col.update_many(F.lit(True), {"Id": F.lit(5)})))])


# -- deletions


@query("SELECT n_nationkey FROM nation WHERE n_nationkey <> 9")
def delete_by_id(t: Tables):
    nations = stored(t, "nation").collection("nation")
    nations.delete(9)
    nations.delete(9)
    return nations.df.select("n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice < 100000, false)")
def delete_many(t: Tables):
    orders = stored(t, "orders").collection("orders")
    orders.delete_many(c("o_totalprice") < 100000)
    return orders.df.select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F')")
def delete_one(t: Tables):
    orders = stored(t, "orders").collection("orders")
    orders.delete_one(c("o_orderstatus") == "F")
    return orders.df.select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def delete_cascades(t: Tables):
    db = stored(t, "customer", "nation", "region")
    db.relate(CUSTOMER_NATION)
    db.relate(NATION_REGION)
    db.collection("region").delete(1)
    return db.collection("customer").df.select("c_custkey")


@query("SELECT name FROM (VALUES ('kept'), ('lone')) v(name)")
def delete_cascades_in_circles(t: Tables):
    """Nodes that refer to nodes: a chain of three and a circle of two go, whatever else refers elsewhere stays."""
    nodes = stored(t).collection("Node", NODE)
    nodes.db.relate(ToOne("Node", "Next", "Node", "Id", on_delete="cascade"))
    nodes.insert_batch([{"Id": i, "Name": n, "Next": x} for i, n, x in ((1, "a", None), (2, "b", 1), (3, "c", 2), (4, "d", 5), (5, "e", 4), (6, "kept", 7), (7, "lone", None))])
    nodes.delete(1)
    nodes.delete(4)
    return nodes.df.select(c("Name").alias("name"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS n_regionkey FROM nation")
def delete_unlinks(t: Tables):
    db = stored(t, "nation", "region")
    db.relate(ToOne("nation", "n_regionkey", "region", "r_regionkey", on_delete="unlink"))
    db.collection("region").delete(2)
    return db.collection("nation").df.select("n_nationkey", "n_regionkey")


@query("SELECT r_regionkey, 'PolicyViolation' AS outcome FROM region")
def delete_restricted(t: Tables):
    db = stored(t, "nation", "region", directory=True)
    db.relate(ToOne("nation", "n_regionkey", "region", "r_regionkey", on_delete="restrict"))
    regions = Database(t.spark, db.source).collection("region")  # relations are kept with the database
    outcome = refused(lambda: regions.delete(2))
    return regions.df.select("r_regionkey", F.lit(outcome).alias("outcome"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey <> 3)")
def delete_orphans(t: Tables):
    db = stored(t, "supplier", "part")
    db.attach("supplies", t.frame("supplies"), "l_suppkey")
    db.relate(ToMany("supplier", "parts", "part", "p_partkey", "supplies", "l_suppkey", "l_partkey", on_owner_delete="deletion"))
    db.collection("supplier").delete(3)
    return db.collection("part").df.select("p_partkey")


# -- indexes and transactions


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_check(t: Tables):
    lines = stored(t).attach("lineitem", t.frame("lineitem"), "l_orderkey")
    return lines.duplicates("l_orderkey", "l_linenumber").select(c("k0").alias("l_orderkey"), c("count").alias("n"))


@query("SELECT step, outcome FROM (VALUES (1, 'UniqueViolation'), (2, 'UniqueViolation'), (3, 'InvalidOperation'), (4, 'InvalidOperation'), (5, 'UniqueViolation'), (6, 'none')) v(step, outcome)")
def unique_indexes(t: Tables):
    db = stored(t, "nation", directory=True)
    nations = db.collection("nation")
    nations.ensure_index("lower(n_name)", unique=True)
    insert = lambda name: lambda: nations.insert({"n_name": name})
    first, found = insert(nations.get(3).n_name.lower()), []
    found += [refused(first), refused(lambda: nations.ensure_index("n_regionkey", unique=True)), refused(lambda: nations.ensure_index("1 + 1")), refused(lambda: nations.ensure_index("n_nationkey"))]
    nations = Database(t.spark, db.source).collection("nation")
    found.append(refused(first))
    nations.drop_index("lower(n_name)")
    nations = Database(t.spark, db.source).collection("nation")
    return rows_of(t, "step int, outcome string", list(enumerate([*found, refused(first)], 1)))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 101, 'kept'")
def transaction_rollback(t: Tables):
    db = stored(t, "nation", directory=True)
    nations = db.collection("nation")

    def fails(db: Database) -> None:
        nations.insert({"n_nationkey": 100, "n_name": "dropped"})
        nations.ensure_index("n_name", unique=True)
        raise KeyError

    def works(db: Database) -> None:
        nations.insert({"n_nationkey": 101, "n_name": "kept"})
        refused(lambda: db.with_transaction(fails), KeyError)

    refused(lambda: db.with_transaction(fails), KeyError)
    db.with_transaction(works)
    assert not nations._unique()
    return nations.df.select("n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name, 'WriteConflict' AS outcome FROM region UNION ALL VALUES (10, 'one', 'WriteConflict'), (11, 'two', 'WriteConflict')")
def two_writers(t: Tables):
    """Two handles write in turn; the slower of two overlapping transactions on a table is refused."""
    db = stored(t, "region", directory=True)
    other = Database(t.spark, db.source)
    db.collection("region").insert({"r_regionkey": 10, "r_name": "one"})

    def late() -> None:
        with db.transaction():
            db.collection("region").insert({"r_regionkey": 12, "r_name": "late"})
            other.collection("region").insert({"r_regionkey": 11, "r_name": "two"})

    outcome = refused(late)
    return other.collection("region").df.select("r_regionkey", "r_name", F.lit(outcome).alias("outcome"))


# -- relations


@query(
    """SELECT l_suppkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE l_suppkey NOT IN (1, 2, 4) UNION ALL
       SELECT 1, unnest([1, 2, 3]) UNION ALL SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey = 2 AND l_partkey <> 5"""
)
def relation_links(t: Tables):
    db = supplied(t)
    suppliers = db.collection("supplier")
    suppliers.set_links("parts", 1, [3, 2, 2])
    suppliers.link("parts", 1, 1, 2)
    suppliers.link("parts", 2, 5)
    suppliers.unlink("parts", 2, 5)
    suppliers.unlink("parts", 4)
    return db.table("supplies").select("l_suppkey", "l_partkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def update_through_reference(t: Tables):
    db = stored(t, "supplier", "nation")
    db.relate(ToOne("supplier", "s_nationkey", "nation", "n_nationkey"))
    db.collection("supplier").update_through(("s_nationkey",), c("s_acctbal") > 5000, {"n_name": F.concat(F.upper("n_name"), F.lit("!"))})
    return db.collection("nation").df.select("n_nationkey", "n_name")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier")
def reference_cleared(t: Tables):
    db = stored(t, "supplier", "nation")
    db.relate(ToOne("supplier", "s_nationkey", "nation", "n_nationkey"))
    db.collection("supplier").set_reference(c("s_acctbal") < 0, "s_nationkey", None)
    return db.collection("supplier").df.select("s_suppkey", "s_nationkey")


@query("SELECT name, next FROM (VALUES ('a', 'b'), ('b', 'a'), ('c', 'b')) v(name, next)")
def insert_graph(t: Tables):
    """Documents in a circle, and one that two others share."""
    nodes = stored(t).collection("Node", NODE)
    nodes.db.relate(ToOne("Node", "Next", "Node", "Id"))
    a, b = {"Name": "a"}, {"Name": "b"}
    a["Next"], b["Next"] = b, a
    nodes.db.relate(ToMany("Node", "Links", "Node", "Id", "NodeLinks"))
    nodes.insert_graph({"Name": "c", "Next": b, "Links": [a, b, a]})
    assert nodes.db.table("NodeLinks").count() == 2
    df = nodes.df
    return df.alias("x").join(df.alias("y"), c("x.Next") == c("y.Id")).select(c("x.Name").alias("name"), c("y.Name").alias("next"))


@query("SELECT n_nationkey, n_regionkey, false AS field FROM nation WHERE n_regionkey <> 0")
def relation_becomes_many(t: Tables):
    db = stored(t, "nation", "region", directory=True)
    db.relate(NATION_REGION)
    db.relate(ToMany("nation", "n_regionkey", "region", "r_regionkey", "nation_regions", "n_nationkey", "n_regionkey"))
    again = Database(t.spark, db.source)
    return again.table("nation_regions").select("n_nationkey", "n_regionkey", F.lit("n_regionkey" in again.table("nation").columns).alias("field"))


@query("SELECT what, outcome FROM (VALUES ('other target', 'InvalidOperation'), ('other policy', 'none'), ('bad policy', 'InvalidOperation'), ('deletion of targets', 'InvalidOperation')) v(what, outcome)")
def relation_definitions(t: Tables):
    db = stored(t, "nation", "region", "supplier")
    db.relate(NATION_REGION)
    again = lambda **kw: refused(lambda: db.relate(ToOne(**({"owner": "nation", "field": "n_regionkey", "target": "region", "target_key": "r_regionkey"} | kw))))
    rows = [("other target", again(target="supplier", target_key="s_suppkey")), ("other policy", again(on_delete="unlink"))]
    return rows_of(t, "what string, outcome string", [*rows, ("bad policy", again(on_delete="maybe")), ("deletion of targets", again(on_delete="deletion"))])


def _typed_events(t: Tables, *kinds: str):
    relations = RelationCatalog().add(ToMany("customer", "events", "events", "event_id", target_field="user_id"))
    frames = {"customer": t.frame("customer"), "events": t.frame("events").where(c("event_type").isin(*kinds)) if kinds else t.frame("events")}
    nav = t.navigate
    nav.catalog, nav.tables = relations, frames.__getitem__
    return nav.many(t.customer, "customer", "events")


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id) ON user_id = c_custkey")
def many_of_type(t: Tables):
    return _typed_events(t).of_type("view", kind="event_type").count("n")


@query("SELECT c_custkey, coalesce(s, 0) AS s FROM customer LEFT JOIN (SELECT user_id, round(sum(value), 3) AS s FROM events WHERE event_type = 'click' GROUP BY user_id) ON user_id = c_custkey")
def many_cast(t: Tables):
    out = _typed_events(t, "click").cast("click", kind="event_type").sum("s", c("value"))
    return out.select("c_custkey", F.round("s", 3).alias("s"))


@query(
    """SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region, false AS shown FROM nation"""
)
def include_all_but(t: Tables):
    relations = RelationCatalog().add(NATION_REGION).add(ToMany("nation", "suppliers", "supplier", "s_suppkey", target_field="s_nationkey"))
    nav = t.navigate
    nav.catalog = relations
    out = nav.include(t.nation, "nation", exclude=("suppliers",)).frame
    return out.select("n_nationkey", c("n_regionkey_value.r_name").alias("region"), F.lit("suppliers" in out.columns).alias("shown"))


# -- elements and refused shapes


@query(
    """SELECT 'first' AS what, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS k UNION ALL SELECT 'first_or_default', -1 UNION ALL
       SELECT 'single', 5 UNION ALL SELECT 'single_or_default', -1 UNION ALL SELECT 'last', (SELECT max(o_orderkey) FROM orders)"""
)
def elements(t: Tables):
    orders = t.orders
    none = c("o_orderkey") < 0
    rows = [
        ("first", orders.order_by_descending("o_totalprice").then_by("o_orderkey").first().o_orderkey),
        ("first_or_default", orders.first_or_default(none, (-1,))[0]),
        ("single", orders.single(c("o_orderkey") == 5).o_orderkey),
        ("single_or_default", orders.single_or_default(none, (-1,))[0]),
        ("last", orders.last_row().o_orderkey),
    ]
    return rows_of(t, "what string, k long", rows)


@query("SELECT what, outcome FROM (VALUES ('first of none', 'CardinalityError'), ('single of two', 'CardinalityError'), ('single of none', 'CardinalityError'), ('average of none', 'CardinalityError'), ('element beyond', 'CardinalityError'), ('negative element', 'RangeError')) v(what, outcome)")
def element_errors(t: Tables):
    orders, none = t.orders, t.orders.where(c("o_orderkey") < 0)
    shapes = {
        "first of none": none.first, "single of two": lambda: orders.single(c("o_orderkey") < 3), "single of none": none.single,
        "average of none": lambda: none.average("o_totalprice"), "element beyond": lambda: none.element(0), "negative element": lambda: orders.element_at(-1),
    }
    return rows_of(t, "what string, outcome string", [(k, refused(f)) for k, f in shapes.items()])


_REFUSED = ["fold", "reverse", "zip", "prepend", "sequence_equal", "composite join key", "comparer", "offset in a format", "time token of a date", "format by column", "fold over a relation", "untyped cast", "bytes un-nested", "unknown function"]


@query(f"SELECT unnest({_REFUSED}) AS what, 'NotSupported' AS outcome")
def refused_shapes(t: Tables):
    orders, many = t.orders, t.navigate.many(t.customer, "customer", "orders")
    shapes = {
        "fold": lambda: orders.aggregate_fold(0), "reverse": lambda: orders.reverse(), "zip": lambda: orders.zip(orders), "prepend": lambda: orders.prepend(1),
        "sequence_equal": lambda: orders.sequence_equal(orders), "composite join key": lambda: orders.join(t.customer, ("o_custkey", "o_orderkey"), "c_custkey"),
        "comparer": lambda: orders.count_by("o_custkey", "nocase"), "offset in a format": lambda: temporal.format_time(c("o_orderdate"), "yyyy z"),
        "time token of a date": lambda: temporal.format_time(c("o_orderdate"), "yyyy HH", "date"), "format by column": lambda: temporal.format_time(c("o_orderdate"), c("o_orderstatus")),
        "fold over a relation": lambda: many.aggregate_fold(0), "untyped cast": lambda: orders.cast("x"),
        "bytes un-nested": lambda: orders.select(b=F.encode("o_orderstatus", "utf-8")).select_many("b"), "unknown function": lambda: functions.call("NO_SUCH_THING"),
    }
    return rows_of(t, "what string, outcome string", [(k, refused(shapes[k])) for k in _REFUSED])


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-07-01' + INTERVAL 2 DAY")
def dt_compare(t: Tables):
    until = temporal.make_datetime(1996, 7, 1, 0, 0, 0) + F.expr("INTERVAL 2 DAYS")
    return t.orders.where((c("o_orderdate") >= temporal.make_datetime(1995, 1, 1, 0, 0, 0)) & (c("o_orderdate") < until)).select("o_orderkey")


@query("SELECT doc_id, octet_length(encode(lang)) AS n FROM documents")
def bytes_length(t: Tables):
    return t.documents.select("doc_id", n=nested.byte_length(F.encode("lang", "utf-8")))


@query("SELECT n_nationkey, n_name || '-' || n_regionkey AS tag, n_nationkey * 2 AS twice FROM nation")
def function_handlers(t: Tables):
    """A registered function, and one that a handler of unknown names makes up."""
    functions.register("TAG_OF", lambda a, b: F.concat(a, F.lit("-"), b.cast("string")))
    functions.on_unknown(lambda name, *args: args[0] * int(name[6:]) if name.startswith("TIMES_") else None)
    out = t.nation.select("n_nationkey", tag=functions.call("tag_of", c("n_name"), c("n_regionkey")), twice=functions.call("TIMES_2", c("n_nationkey")))
    functions.unregister("TAG_OF")
    return out


# -- handlers and streams


@query("SELECT event, n FROM (VALUES ('inserting', 2), ('inserted', 2), ('updating', 1), ('updated', 1), ('deleting', 2), ('deleted', 2)) v(event, n)")
def change_handlers(t: Tables):
    db = stored(t, "region")
    regions, seen = db.collection("region"), []

    def saw(kind: str):
        return lambda change: seen.append((kind, (change.old_items if change.items is None else change.items).count()))

    for kind in ("inserting", "inserted", "updating", "updated", "deleting", "deleted"):
        db.handlers.on("region", kind, saw(kind))
    regions.insert_batch([{"r_name": "x"}, {"r_name": "y"}])
    regions.update({"r_regionkey": 1, "r_name": "z"})
    regions.delete_many(c("r_name").isin("x", "y"))
    return rows_of(t, "event string, n long", seen)


@query("SELECT n_nationkey, n_name AS was, n_name || '2' AS fresh FROM nation WHERE n_regionkey = 1")
def handler_items(t: Tables):
    """What a handler of updates sees of each document, before and after."""
    db, seen = stored(t, "nation"), []
    db.handlers.on("nation", "updated", lambda change: seen.append(change))
    db.collection("nation").update_many(c("n_regionkey") == 1, {"n_name": F.concat("n_name", F.lit("2"))})
    (change,) = seen
    return change.old_items.select("n_nationkey", c("n_name").alias("was")).join(change.items.select("n_nationkey", c("n_name").alias("fresh")), "n_nationkey")


@query("SELECT r_regionkey, 'Aborted' AS outcome, 1 AS once, true AS removed FROM region UNION ALL SELECT 5, 'Aborted', 1, true")
def handler_refusals(t: Tables):
    """A handler that raises undoes the write; one that answers "remove" runs once; one can be taken back."""
    db, once = stored(t, "region"), []

    def refuse(change) -> None:
        if change.items.where("r_name = 'bad'").limit(1).count():
            raise ValueError("bad")

    db.handlers.on("region", "inserted", refuse)
    db.handlers.on("region", "inserting", lambda change: "remove" if once.append(1) is None else None)
    regions = db.collection("region")
    outcome = refused(lambda: regions.insert({"r_name": "bad"}))
    removed = db.handlers.unregister("region", "inserted", refuse)
    regions.insert({"r_name": "bad"})
    return regions.df.select("r_regionkey", F.lit(outcome).alias("outcome"), F.lit(len(once)).alias("once"), F.lit(removed).alias("removed"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def stream_into_collection(t: Tables):
    db = stored(t)
    frame = t.frame("events")
    col = db.collection("clicks", frame.select("event_id", "event_type").schema, "event_id")
    copy = f"{scratch_dir(t.spark)}/stream-{db.source[7:]}"
    frame.select("event_id", "event_type").write.parquet(copy)
    stream = t.spark.readStream.schema(frame.select("event_id", "event_type").schema).parquet(copy)
    stream_into(Query(stream).where(c("event_type") == "click").df, col, f"{copy}-marks").awaitTermination()
    return col.df


# -- files


def _files(t: Tables) -> FileStore:
    fs = FileStore(stored(t))
    fs.upload_bulk([("/a/b/big.bin", bytes(range(256)) * 200), ("/a/small.txt", b"hi"), ("/c.txt", b"")], {"k": "v"})
    return fs


@query("SELECT path, size, directory FROM (VALUES ('/a', 0, true), ('/a/b', 0, true), ('/a/b/big.bin', 51200, false), ('/a/small.txt', 2, false)) v(path, size, directory)")
def files_walk(t: Tables):
    return _files(t).walk("/a").select("path", "size", "directory")


@query("SELECT path, pos FROM (VALUES ('/a/small.txt', 0), ('/a/b', 1)) v(path, pos)")
def files_list(t: Tables):
    found = _files(t).list("/a", sort="size", descending=True, limit=2)
    return rows_of(t, "path string, pos int", [(r.path, i) for i, r in enumerate(found.collect())])


@query(f"SELECT what, hex FROM (VALUES ('middle', 'FDFEFF000102'), ('written', 'FD41424344020304'), ('sparse', '0000656E64'), ('chunks', '1'), ('missing', 'KeyNotFound')) v(what, hex) WHERE {CHUNK} = 16384")
def files_read_write(t: Tables):
    fs = _files(t)
    middle = fs.read_at("/a/b/big.bin", 253, 6)
    fs.write_at("/a/b/big.bin", CHUNK - 2, b"ABCD")
    written = fs.read_at("/a/b/big.bin", CHUNK - 3, 8)
    fs.write_at("/sparse", 3 * CHUNK + 1, b"end")
    rows = [("middle", middle.hex().upper()), ("written", written.hex().upper()), ("sparse", fs.read_at("/sparse", 3 * CHUNK - 1, 9).hex().upper())]
    return rows_of(t, "what string, hex string", [*rows, ("chunks", str(fs.chunks.where("path = '/sparse'").count())), ("missing", refused(lambda: fs.download("/none")))])


@query("SELECT path, k, modified FROM (VALUES ('/a/small.txt', 'x=1', 5), ('/c.txt', 'k=v', 6)) v(path, k, modified)")
def files_metadata(t: Tables):
    fs = _files(t)
    fs.set_metadata("/a/small.txt", "x", "1")
    fs.delete_metadata("/a/small.txt", "k")
    fs.set_modified("/a/small.txt", 5)
    fs.set_modified("/c.txt", 6)
    pairs = F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return fs.entries.where("not directory and size < 3").select("path", pairs.alias("k"), "modified")


@query("SELECT path, n FROM (VALUES ('/c.txt', 0), ('/z/moved/big.bin', 51200), ('/z/copy.txt', 2)) v(path, n)")
def files_move_copy_delete(t: Tables):
    fs = _files(t)
    fs.move("/a/b", "/z/moved")
    fs.copy("/a/small.txt", "/z/copy.txt")
    fs.delete("/a")
    full = fs.contents().select("path", F.octet_length("content").alias("n"))
    return fs.entries.where("not directory").select("path").join(full, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))


# -- façade


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000 AND s_nationkey IN (1, 2, 3, 8) AND s_suppkey < 90 AND s_suppkey <> 7 AND NOT (s_nationkey = 2 AND s_acctbal > 9000)")
def facade_filters(t: Tables):
    f, b = mongo.Filter, mongo.QueryBuilder
    col = mongo.MongoDatabase(stored(t, "supplier")).get_collection("supplier")
    col.delete_one(f.eq("s_suppkey", 7))
    col.delete_many(f.eq("s_nationkey", 2) & f.gt("s_acctbal", 9000))
    return col.find(f.gt("s_acctbal", 1000) & b.IN("s_nationkey", [1, 2, 3, 8]) & b.LT("s_suppkey", 90)).select("s_suppkey").df


@query("SELECT what, v FROM (VALUES ('count', 2), ('replaced', 1), ('age', 9), ('deleted', 1), ('left', 1), ('names', 1), ('dropped', 1), ('bad cast', 1)) v(what, v)")
def facade_verbs(t: Tables):
    base = mongo.MongoClient(t.spark, "memory:").get_database("m")
    col = base.get_collection("U", schema({"Name": "string", "Age": "int32"}))
    col.insert_many([{"Name": "a", "Age": 1}, {"Name": "b", "Age": 5}])
    f = mongo.Filter
    rows = [("count", col.count_documents(f.empty())), ("replaced", col.replace_one(f.eq("Name", "a"), {"Name": "c", "Age": 9}))]
    doc = mongo.BsonDocument(col.find(f.eq("Name", "c")).first())
    rows += [("age", doc["Age"].as_int), ("deleted", col.delete_many(f.lt("Age", 6))), ("left", col.count_documents(f.empty())), ("names", len(base.list_collection_names()))]
    return rows_of(t, "what string, v int", [*rows, ("dropped", int(base.drop_collection("U"))), ("bad cast", int(refused(lambda: doc["Name"].as_int) == "CastError"))])


@query("SELECT _type, n FROM (VALUES ('Circle', 2), ('Rectangle', 1)) v(_type, n)")
def polymorphic_collection(t: Tables):
    shapes = stored(t).collection("Shape", polymorphic({"Color": "string"}, {"Radius": "float64"}, {"Width": "float64", "Height": "float64"}))
    shapes.insert_batch([{"_type": "Circle", "Radius": 1.0}, {"_type": "Rectangle", "Width": 1.0, "Height": 2.0}, {"_type": "Circle", "Color": "red"}])
    return shapes.query().group_by("_type").select(_type="_type", n=F.count("*")).df


@query("SELECT true AS scans, true AS pushed")
def explained(t: Tables):
    text = t.orders.where(c("o_orderkey") == 7).select("o_orderstatus").explain()
    return rows_of(t, "scans boolean, pushed boolean", [("Scan parquet" in text, "PushedFilters: [" in text)])

