"""Registered queries: navigation over relations and chains over to-many relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.plans.query import sum_or_zero
from docframe.plans.registry import Tables, query

c = F.col


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def nav_to_one(t: Tables):
    q = t.navigate.reference(t.orders, "orders", "o_custkey", "c_nationkey", "n_regionkey")
    return q.select("o_orderkey", c_name="o_custkey_c_name", n_name="o_custkey_c_nationkey_n_name", r_name="o_custkey_c_nationkey_n_regionkey_r_name")


@query("SELECT o_orderkey, coalesce(o_custkey <> 0, false) AS has FROM orders")
def nav_has_value(t: Tables):
    return t.orders.select("o_orderkey", has=t.navigate.has_value("o_custkey"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def nav_where(t: Tables):
    return t.navigate.reference(t.orders, "orders", "o_custkey").where(c("o_custkey_c_mktsegment") == "MACHINERY").select("o_orderkey")


@query("SELECT c_custkey, o_orderkey, round(o_totalprice, 2) AS p FROM customer JOIN orders ON c_custkey = o_custkey")
def flatten_to_many(t: Tables):
    return t.navigate.flatten(t.customer, "customer", "orders").select("c_custkey", "o_orderkey", p=F.round("o_totalprice", 2))


@query("SELECT c_custkey, l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2")
def two_hop_flatten(t: Tables):
    q = t.navigate.flatten(t.customer.where(c("c_mktsegment") == "BUILDING"), "customer", "orders", "lines")
    return q.frame.groupBy("c_custkey", "l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON s_suppkey = l_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size = 7")
def flatten_link_table(t: Tables):
    return t.navigate.flatten(t.supplier, "supplier", "parts").where(c("p_size") == 7).select("s_suppkey", "p_partkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def many_any(t: Tables):
    return t.navigate.where_any(t.customer, "customer", "orders").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def many_any_pred(t: Tables):
    return t.navigate.where_any(t.customer, "customer", "orders", c("o_totalprice") > 350000).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 20000)")
def many_all_pred(t: Tables):
    return t.navigate.where_all(t.customer, "customer", "orders", c("o_totalprice") > 20000).select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def many_count(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").count("n")


@query("SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def many_count_pred(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").count("n", c("o_orderstatus") == "F")


@query("SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS s, round(min(o_totalprice), 2) AS lo, round(max(o_totalprice), 2) AS hi, round(avg(o_totalprice), 7) AS a FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def many_sum_min_max_avg(t: Tables):
    out = t.navigate.many(t.customer, "customer", "orders").aggregate(s=F.sum("o_totalprice"), lo=F.round(F.min("o_totalprice"), 2), hi=F.round(F.max("o_totalprice"), 2), a=F.round(F.avg("o_totalprice"), 7))
    return out.withColumn("s", F.round(F.coalesce("s", F.lit(0.0)), 2))


@query("SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def many_select_array(t: Tables):
    out = t.navigate.many(t.customer, "customer", "orders").select("o_orderkey").to_array("keys")
    return out.withColumn("keys", F.array_join(F.transform("keys", lambda x: x.cast("string")), ","))


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_partkey = 17)")
def many_contains(t: Tables):
    return t.navigate.where_contains(t.supplier, "supplier", "parts", 17).select("s_suppkey")


@query("SELECT c_custkey, o_orderkey AS top FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) o ON c_custkey = o_custkey AND r = 1")
def many_top1(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").max_by("o_totalprice", "top", c("o_orderkey"))


@query("SELECT c_custkey, max(o_orderkey) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def many_last_by_id(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").last("last", c("o_orderkey"))


@query("SELECT c_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') = 1 THEN max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') END AS one FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def many_single_or_null(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").where(c("o_orderstatus") == "P").single("one", c("o_orderkey"))


@query("SELECT c_custkey, o_orderkey AS third FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) o ON c_custkey = o_custkey AND r = 3")
def many_element_at(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").order_by("o_orderdate").element("third", 2, x=c("o_orderkey"))


@query("SELECT c_custkey, count(DISTINCT o_orderpriority) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def many_distinct_count(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").select("o_orderpriority").distinct().count("n")


@query(
    """SELECT c_custkey, count(r) AS n FROM customer LEFT JOIN (SELECT *, 1 AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1) o
       ON c_custkey = o_custkey GROUP BY c_custkey"""
)
def many_distinct_by(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").distinct_by("o_orderstatus").count("n")


@query("SELECT c_custkey, string_agg(k || '=' || n, ',' ORDER BY k) AS counts FROM customer LEFT JOIN (SELECT o_custkey, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1, 2) ON c_custkey = o_custkey GROUP BY c_custkey")
def many_count_by(t: Tables):
    out = t.navigate.many(t.customer, "customer", "orders").count_by("o_orderstatus")
    return out.withColumn("counts", F.array_join(F.transform("counts", lambda x: F.concat_ws("=", x["Key"], x["Value"].cast("string"))), ","))


@query("SELECT c_custkey, coalesce(string_agg(k || '=' || n, ',' ORDER BY k), '') AS groups FROM customer LEFT JOIN (SELECT o_custkey, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 3) ON c_custkey = o_custkey GROUP BY c_custkey")
def many_group_having(t: Tables):
    out = t.navigate.many(t.customer, "customer", "orders").group_by("o_orderstatus", F.count("*") > 3, Count=F.count("*"))
    return out.withColumn("groups", F.array_join(F.transform("groups", lambda x: F.concat_ws("=", x["Key"], x["Count"].cast("string"))), ","))


@query(
    """SELECT c_custkey, count(o.o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM (SELECT *, sum(CASE WHEN o_totalprice > 30000 THEN 0 ELSE 1 END)
       OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS f FROM orders) WHERE f = 0) o ON c_custkey = o.o_custkey GROUP BY c_custkey"""
)
def many_take_while(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").order_by("o_orderdate").take_while(c("o_totalprice") > 30000).count("n")


@query(
    """SELECT c_custkey, count(o.o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM (SELECT *, sum(CASE WHEN o_totalprice > 30000 THEN 0 ELSE 1 END)
       OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS f FROM orders) WHERE f > 0) o ON c_custkey = o.o_custkey GROUP BY c_custkey"""
)
def many_skip_while(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").order_by("o_orderdate").skip_while(c("o_totalprice") > 30000).count("n")


@query(
    """SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS s FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) o
       ON c_custkey = o_custkey AND r BETWEEN 2 AND 3 GROUP BY c_custkey"""
)
def many_page_sum(t: Tables):
    out = t.navigate.many(t.customer, "customer", "orders").order_by("o_totalprice", descending=True).page(1, 2).sum("s", c("o_totalprice"))
    return out.withColumn("s", F.round("s", 2))


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN '-1' ELSE string_agg(o_orderkey, ',' ORDER BY o_orderkey) END AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def many_default_if_empty(t: Tables):
    out = t.navigate.many(t.customer, "customer", "orders").select("o_orderkey").default_if_empty(-1, "keys")
    return out.withColumn("keys", F.array_join(F.transform("keys", lambda x: x.cast("string")), ","))


@query("SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def many_intersect(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").select("o_orderpriority").intersect(["1-URGENT", "2-HIGH"]).count("n")


@query("SELECT c_custkey, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT')) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def many_except_distinct(t: Tables):
    return t.navigate.many(t.customer, "customer", "orders").select("o_orderpriority").except_(["1-URGENT"]).distinct().count("n")


@query("SELECT c_custkey, count(DISTINCT o_orderpriority) + 1 AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def many_union(t: Tables):
    out = t.navigate.many(t.customer, "customer", "orders").select("o_orderpriority").union(["9-NEW"], "items")
    return out.select("c_custkey", F.size("items").cast("long").alias("n"))


@query("SELECT o_orderkey, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') > 0 AS any_r, coalesce(bool_and(l_quantity > 2), true) AS all_2 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def many_any_all_columns(t: Tables):
    chain = t.navigate.many(t.orders, "orders", "lines")
    return chain.any("any_r", c("l_returnflag") == "R").join(chain.all(c("l_quantity") > 2, "all_2"), "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49 AND l_discount > 0.09))")
def many_nested_any(t: Tables):
    nav = t.navigate
    inner = nav.where_any(t.orders, "orders", "lines", (c("l_quantity") > 49) & (c("l_discount") > 0.09))
    return t.customer.where_exists(inner, "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT n_nationkey, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def hydrate_to_one(t: Tables):
    q = t.navigate.include(t.nation, "nation", "n_regionkey")
    counted = q.group_join(t.customer, "n_nationkey", "c_nationkey").select("n_nationkey", "n_regionkey_value", n=F.count("*"))
    return counted.select("n_nationkey", r_name=c("n_regionkey_value.r_name"), n="n")


@query("SELECT c_custkey, coalesce(string_agg(o_orderkey || o_orderstatus, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def hydrate_to_many(t: Tables):
    q = t.navigate.include(t.customer, "customer", "orders")
    return q.select("c_custkey", orders=F.array_join(F.transform("orders", lambda x: F.concat(x["o_orderkey"].cast("string"), x["o_orderstatus"])), ","))


_PRI = "SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders WHERE o_orderstatus = "


@query(f"SELECT c_custkey, count(x.p) AS n FROM customer LEFT JOIN ({_PRI}'F' INTERSECT {_PRI}'O') x ON x.k = c_custkey GROUP BY c_custkey")
def many_intersect_relation(t: Tables):
    chain = lambda s: t.navigate.many(t.customer, "customer", "orders").where(c("o_orderstatus") == s).select("o_orderpriority")
    return chain("F").intersect_with(chain("O")).distinct().count("n")


@query(f"SELECT c_custkey, count(x.p) > 0 AS some FROM customer LEFT JOIN ({_PRI}'F' EXCEPT {_PRI}'O') x ON x.k = c_custkey GROUP BY c_custkey")
def many_except_relation(t: Tables):
    chain = lambda s: t.navigate.many(t.customer, "customer", "orders").where(c("o_orderstatus") == s).select("o_orderpriority")
    return chain("F").except_with(chain("O")).any("some")


@query(f"SELECT c_custkey, count(x.p) AS n FROM customer LEFT JOIN ({_PRI}'F' UNION {_PRI}'P') x ON x.k = c_custkey GROUP BY c_custkey")
def many_union_relation(t: Tables):
    chain = lambda s: t.navigate.many(t.customer, "customer", "orders").where(c("o_orderstatus") == s).select("o_orderpriority")
    return chain("F").union_with(chain("P")).count("n")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus IN ('F', 'P') GROUP BY c_custkey")
def many_concat_relation(t: Tables):
    chain = lambda s: t.navigate.many(t.customer, "customer", "orders").where(c("o_orderstatus") == s).select("o_orderpriority")
    return chain("F").concat_with(chain("P")).count("n")


@query("SELECT n_nationkey, r_name, count(c_custkey) AS n FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def hydrate_nested(t: Tables):
    q = t.navigate.include(t.customer, "customer", "c_nationkey.n_regionkey")
    per = q.frame.groupBy(c("c_nationkey_value.n_nationkey").alias("k"), c("c_nationkey_value.n_regionkey_value.r_name").alias("r")).agg(F.count("*").alias("m"))
    out = t.navigate.include(t.nation, "nation", "n_regionkey").frame.join(per, c("k") == c("n_nationkey"), "left")
    return out.select("n_nationkey", F.coalesce("r", c("n_regionkey_value.r_name")).alias("r_name"), F.coalesce("m", F.lit(0)).alias("n"))
