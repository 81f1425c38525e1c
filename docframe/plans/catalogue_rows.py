"""Registered queries: scans, filters, projections, order, aggregates, joins and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import maths, nested, strings
from docframe.operators import ordering
from docframe.plans.query import Query, sum_or_zero
from docframe.plans.registry import rows_of, stored, Tables, query
from docframe.sources import readers
from docframe.types import schema

c = F.col


# -- scans, filters, projections


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def scan_orders(t: Tables):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", o_totalprice=F.round("o_totalprice", 2))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def get_by_id(t: Tables):
    orders = stored(t, "orders").collection("orders")
    return rows_of(t, "o_orderkey long, o_orderstatus string", [(r.o_orderkey, r.o_orderstatus) for r in [orders.get(7)]])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 11")
def get_by_custom_id(t: Tables):
    parts = stored(t, "part").collection("part")
    return rows_of(t, "p_partkey long, p_name string", [parts.get(parts.get(11).p_name, "p_name")[:2]])


@query("SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 1000 GROUP BY n_name")
def raw_sql(t: Tables):
    text = "SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > :least GROUP BY n_name"
    return stored(t, "nation", "supplier").sql(text, least=1000)


@query("SELECT k, v FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) x(k, v)")
def constant_rows(t: Tables):
    return readers.constants(t.spark, [{"k": 1, "v": "a"}, {"k": 2}, {"v": "c", "k": 3}], schema({"k": "int32", "v": "string"}, None))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND NOT o_totalprice < 100000) OR o_orderpriority = '1-URGENT'")
def where_and_or_not(t: Tables):
    return t.orders.where(((c("o_orderstatus") == "F") & ~(c("o_totalprice") < 100000)) | (c("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus || ':' || o_orderpriority AS tag, o_custkey * 2 AS twice FROM orders")
def select_struct_flat(t: Tables):
    made = nested.object_of(tag=strings.concat(c("o_orderstatus"), ":", c("o_orderpriority")), twice=c("o_custkey") * 2)
    return t.orders.select("o_orderkey", made=made).select("o_orderkey", tag=c("made.tag"), twice=c("made.twice"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band FROM part")
def conditional_case(t: Tables):
    return t.part.select("p_partkey", band=F.when(c("p_size") < 10, "small").when(c("p_size") < 30, "medium").otherwise("large"))


@query("SELECT doc_id, coalesce(CASE WHEN lang <> 'en' THEN lang END, 'none') AS v FROM documents")
def coalesce_null(t: Tables):
    return t.documents.select("doc_id", v=F.coalesce(F.when(c("lang") != "en", c("lang")), F.lit("none")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 5, 9, 42)")
def in_list(t: Tables):
    return t.orders.where(nested.in_list(c("o_custkey"), [1, 5, 9, 42])).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE 1 = 0")
def in_empty(t: Tables):
    return t.orders.where(nested.in_list(c("o_custkey"), [])).select("o_orderkey")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS p FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
def between_range(t: Tables):
    return t.orders.where(c("o_totalprice").between(50000, 60000)).select("o_orderkey", p=F.round("o_totalprice", 2))


@query("SELECT p_partkey FROM part WHERE p_type ILIKE '%A_%e%'")
def like_ci(t: Tables):
    return t.part.where(strings.like(c("p_type"), "%A_%e%")).select("p_partkey")


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '[0-9]{2}')")
def regex_match(t: Tables):
    return t.pages.where(strings.is_match(c("url"), "[0-9]{2}")).select("page_id")


@query("SELECT event_id, TRY_CAST(event_id % 7 || 'x' AS BIGINT) AS bad, TRY_CAST(trim(' ' || event_id || ' ') AS BIGINT) AS good, CAST(trunc(value) AS BIGINT) AS whole FROM events")
def cast_parse(t: Tables):
    text = (c("event_id") % 7).cast("string")
    return t.events.select("event_id", bad=maths.parse(F.concat(text, F.lit("x"))), good=maths.parse(F.concat(F.lit(" "), c("event_id").cast("string"), F.lit(" "))), whole=maths.to_int(c("value")))


@query("SELECT event_id, event_id // nullif(user_id % 5, 0) AS d, event_id % nullif(user_id % 5, 0) AS m, round(event_id / nullif(user_id % 5, 0), 6) AS r FROM events")
def int_div_mod(t: Tables):
    by = c("user_id") % 5
    return t.events.select("event_id", d=maths.int_divide(c("event_id"), by), m=maths.modulo(c("event_id"), by), r=F.round(maths.divide(c("event_id"), by), 6))


@query("SELECT p_partkey, -p_size + p_partkey * 3 - 1 AS v FROM part")
def arithmetic(t: Tables):
    return t.part.select("p_partkey", v=-c("p_size") + c("p_partkey") * 3 - 1)


@query("SELECT doc_id FROM documents WHERE (CASE WHEN lang <> 'en' THEN lang END) IS NOT DISTINCT FROM NULL")
def null_safe_eq(t: Tables):
    return t.documents.where(F.when(c("lang") != "en", c("lang")).eqNullSafe(F.lit(None))).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F' AND o_custkey % 4 IS NOT DISTINCT FROM 1")
def structural_equality(t: Tables):
    made = nested.object_of(status=c("o_orderstatus"), rest=nested.object_of(mod=c("o_custkey") % 4))
    return t.orders.with_column("made", made).where(nested.equals_object(c("made"), {"status": "F", "rest": {"mod": 1}})).select("o_orderkey")


@query("SELECT event_id FROM events WHERE (CASE WHEN value > 50 THEN value END) IS NOT NULL")
def has_value(t: Tables):
    return t.events.where(F.when(c("value") > 50, c("value")).isNotNull()).select("event_id")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def of_type(t: Tables):
    return t.events.with_column("_type", c("event_type")).of_type("purchase").select("event_id", "user_id")


@query("SELECT event_id, round(value, 4) AS v FROM events WHERE event_type = 'click'")
def cast_type(t: Tables):
    return t.events.with_column("_type", c("event_type")).of_type("click").cast("click").select("event_id", v=F.round("value", 4))


@query("SELECT event_id, event_type = 'view' AS is_view FROM events")
def is_type(t: Tables):
    events = Query(t.events.frame, id="event_id", kind="event_type")
    return events.select("event_id", is_view=events.is_type("view"))


# -- order and paging


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def order_by_then_by(t: Tables):
    return t.orders.order_by("o_orderpriority").then_by_descending("o_totalprice").then_by("o_orderkey").select("o_orderkey", "o_orderpriority").take(50)


@query("SELECT n_name FROM nation ORDER BY n_name DESC LIMIT 5")
def order_descending(t: Tables):
    return t.nation.select("n_name").order(descending=True).take(5)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
def take(t: Tables):
    return t.orders.order_by("o_orderkey").select("o_orderkey").take(10)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
def skip_take(t: Tables):
    return t.orders.order_by_descending("o_totalprice").then_by("o_orderkey").skip(30).take(20).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 40) ORDER BY o_orderkey OFFSET 25")
def take_then_skip(t: Tables):
    return t.orders.order_by("o_orderkey").take(40).skip(25).select("o_orderkey")


@query("SELECT round(sum(o_totalprice), 2) AS s FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)")
def take_then_sum(t: Tables):
    return t.orders.order_by("o_orderkey").take(100).aggregate(s=F.round(sum_or_zero(c("o_totalprice")), 2))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def last_by_order(t: Tables):
    return t.orders.order_by("o_orderdate").last().select("o_orderkey")


@query("SELECT max(o_orderkey) AS o_orderkey FROM orders")
def last_by_id(t: Tables):
    return t.orders.last().select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 5")
def element_at(t: Tables):
    return t.orders.order_by("o_totalprice").then_by("o_orderkey").element_at(5).select("o_orderkey")


@query("SELECT p_partkey, round(p_retailprice, 2) AS p FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_k(t: Tables):
    return t.part.order_by_descending("p_retailprice").then_by("p_partkey").select("p_partkey", p=F.round("p_retailprice", 2)).take(25)


_RUN = "sum(CASE WHEN value < 90 THEN 0 ELSE 1 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id FROM (SELECT event_id, {_RUN} AS f FROM events) WHERE f = 0")
def take_while(t: Tables):
    return t.events.order_by("ts").take_while(c("value") < 90).select("event_id")


@query(f"SELECT event_id FROM (SELECT event_id, {_RUN} AS f FROM events) WHERE f > 0")
def skip_while(t: Tables):
    return t.events.order_by("ts").skip_while(c("value") < 90).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, sum(CASE WHEN value > 5 THEN 0 ELSE 1 END) OVER (ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS f FROM events) WHERE f = 0")
def take_while_descending(t: Tables):
    return t.events.order_by_descending("value").take_while(c("value") > 5).select("event_id")


@query("SELECT CAST(NULL AS BIGINT) AS o_orderkey, 'none' AS o_orderstatus")
def default_if_empty(t: Tables):
    return t.orders.where(c("o_orderkey") < 0).select("o_orderkey", "o_orderstatus").default_if_empty(o_orderstatus="none")


@query("SELECT r_name FROM region")
def default_if_not_empty(t: Tables):
    return t.region.select("r_name").default_if_empty(r_name="none")


# -- aggregates


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders")
def count_pred(t: Tables):
    return t.orders.aggregate(n=F.count("*"), f=F.count_if(c("o_orderstatus") == "F"))


@query("SELECT coalesce(sum(o_totalprice), 0) AS s FROM orders WHERE o_orderkey < 0")
def sum_empty_zero(t: Tables):
    return t.orders.where(c("o_orderkey") < 0).aggregate(s=sum_or_zero(c("o_totalprice")))


@query("SELECT round(avg(s_acctbal), 4) AS a, round(min(s_acctbal), 2) AS lo, round(max(s_acctbal), 2) AS hi FROM supplier")
def avg_min_max(t: Tables):
    return t.supplier.aggregate(a=F.round(F.avg("s_acctbal"), 4), lo=F.round(F.min("s_acctbal"), 2), hi=F.round(F.max("s_acctbal"), 2))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 1")
def min_by_row(t: Tables):
    return t.supplier.min_by("s_acctbal").select("s_suppkey", "s_name")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def max_by_row(t: Tables):
    return t.supplier.max_by("s_acctbal").select("s_suppkey", "s_name")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t: Tables):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 10")
def distinct_ordered(t: Tables):
    return t.part.order_by("p_brand").select("p_brand").distinct().take(10)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def distinct_by(t: Tables):
    return t.orders.distinct_by("o_custkey").select("o_orderkey", "o_custkey")


@query('SELECT p_brand AS "Key", count(*) AS "Value" FROM part GROUP BY p_brand')
def count_by(t: Tables):
    return t.part.count_by("p_brand")


@query("SELECT count(*) FILTER (WHERE NOT coalesce(o_totalprice > 0, false)) = 0 AS all_positive, count(*) FILTER (WHERE o_totalprice > 400000) > 0 AS any_large, count(*) FILTER (WHERE o_custkey = 3) > 0 AS has_3 FROM orders")
def any_all_contains(t: Tables):
    orders = t.orders
    found = (orders.all(c("o_totalprice") > 0), orders.any(c("o_totalprice") > 400000), orders.contains("o_custkey", 3))
    return rows_of(t, "all_positive boolean, any_large boolean, has_3 boolean", [found])


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def group_agg(t: Tables):
    rows = t.lineitem.where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return (
        rows.group_by("l_returnflag", "l_linestatus")
        .select(
            l_returnflag="l_returnflag",
            l_linestatus="l_linestatus",
            sum_qty=F.round(sum_or_zero(c("l_quantity")), 2),
            sum_base_price=F.round(sum_or_zero(c("l_extendedprice")), 2),
            sum_disc_price=F.round(sum_or_zero(c("l_extendedprice") * (1 - c("l_discount"))), 2),
            avg_qty=F.round(F.avg("l_quantity"), 4),
            avg_disc=F.round(F.avg("l_discount"), 6),
            count_order=F.count("*"),
        )
        .order_by("l_returnflag")
        .then_by("l_linestatus")
    )


@query("SELECT o_orderstatus AS s, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2")
def group_composite_key(t: Tables):
    return t.orders.group_by(s="o_orderstatus", y=F.year("o_orderdate")).select(s="s", y="y", n=F.count("*"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 200000")
def group_having(t: Tables):
    return t.orders.group_by("o_custkey").having((F.count("*") > 12) & (F.max("o_totalprice") > 200000)).select(o_custkey="o_custkey", n=F.count("*"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 20")
def group_order_by_agg(t: Tables):
    out = t.orders.group_by("o_custkey").select(o_custkey="o_custkey", total=sum_or_zero(c("o_totalprice")))
    return out.order_by_descending("total").then_by("o_custkey").take(20).select("o_custkey", s=F.round("total", 2))


@query("SELECT event_type, count(*) FILTER (WHERE value > 10) AS n FROM events GROUP BY event_type")
def group_count_if(t: Tables):
    return t.events.group_by("event_type").select(event_type="event_type", n=F.count_if(c("value") > 10))


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def group_count_distinct(t: Tables):
    return t.events.group_by("event_type").select(event_type="event_type", n=F.count_distinct("user_id"))


@query("SELECT event_type, round(max(CASE WHEN user_id < 50 THEN value END), 6) AS m FROM events GROUP BY event_type")
def group_where_select_max(t: Tables):
    return t.events.group_by("event_type").select(event_type="event_type", m=F.round(F.max(F.when(c("user_id") < 50, c("value"))), 6))


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
def group_key_member_year(t: Tables):
    return t.orders.group_by(y=F.year("o_orderdate"), m=F.month("o_orderdate")).select(y="y", m="m", n=F.count("*"))


@query("SELECT event_type || ':' || count(*) AS label FROM events GROUP BY event_type")
def group_concat_label(t: Tables):
    out = t.events.group_by("event_type").select(k="event_type", n=F.count("*"))
    return out.select(label=strings.format_string("{0}:{1}", c("k"), c("n")))


@query("SELECT event_type, bool_or(value > 99) AS any_big, bool_and(value >= 0) AS all_pos FROM events GROUP BY event_type")
def group_any_all(t: Tables):
    return t.events.group_by("event_type").select(event_type="event_type", any_big=F.bool_or(c("value") > 99), all_pos=F.bool_and(c("value") >= 0))


@query("SELECT event_type, CASE WHEN count(*) > 1000 THEN 'many' ELSE 'few' END AS size, round(sum(value) / count(*), 6) AS mean FROM events GROUP BY event_type")
def group_expressions(t: Tables):
    return t.events.group_by("event_type").select(event_type="event_type", size=F.when(F.count("*") > 1000, "many").otherwise("few"), mean=F.round(F.sum("value") / F.count("*"), 6))


@query("SELECT k, count(*) AS n FROM (SELECT CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS k FROM events) WHERE k IS NOT NULL GROUP BY k")
def group_null_keys_dropped(t: Tables):
    return t.events.group_by(k=F.when(c("user_id") % 3 > 0, c("user_id") % 3)).select(k="k", n=F.count("*"))


@query("SELECT k, count(*) AS n FROM (SELECT CASE WHEN event_type <> 'view' THEN event_type END AS k FROM events) GROUP BY k")
def group_null_strings_kept(t: Tables):
    return t.events.group_by(k=F.when(c("event_type") != "view", c("event_type"))).select(k="k", n=F.count("*"))


@query("SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_nationkey) AS items FROM nation GROUP BY n_regionkey")
def group_array_items(t: Tables):
    out = t.nation.group_by("n_regionkey").items()
    return out.select(k=c("Key"), items=F.array_join(F.transform("Items", lambda x: x["n_name"]), ","))


@query("SELECT p_brand, round(avg(CAST(p_retailprice AS DECIMAL(28, 10))), 4) AS a FROM part GROUP BY p_brand")
def exact_decimal_average(t: Tables):
    return t.part.group_by("p_brand").select(p_brand="p_brand", a=F.round(maths.exact_average(c("p_retailprice")).cast("double"), 4))


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def group_concat_separator(t: Tables):
    return t.nation.group_by("n_regionkey").select(n_regionkey="n_regionkey", names=F.array_join(F.array_sort(F.collect_list("n_name")), "|"))


# -- chained queries inside groups


@query("SELECT o_custkey, o_orderkey AS first FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def group_first_ordered(t: Tables):
    return t.orders.group_by("o_custkey").chain().order_by("o_totalprice", descending=True).first("first", c("o_orderkey"))


@query(
    """SELECT k.o_custkey, coalesce(s.s, 0) AS s FROM (SELECT DISTINCT o_custkey FROM orders) k LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM
       (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r BETWEEN 2 AND 4 GROUP BY o_custkey) s USING (o_custkey)"""
)
def group_chain_page_sum(t: Tables):
    chain = t.orders.group_by("o_custkey").chain().where(c("o_orderstatus") == "O").order_by("o_orderdate").page(1, 3)
    return chain.sum("s", c("o_totalprice")).withColumn("s", F.round("s", 2))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey")
def group_chain_distinct_count(t: Tables):
    return t.orders.group_by("o_custkey").chain().select("o_orderpriority").distinct().count("n")


@query(
    "SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3 GROUP BY user_id"
)
def group_chain_take_array(t: Tables):
    out = t.events.group_by("user_id").chain().order_by("ts").take(3).select("event_type").to_array("kinds")
    return out.withColumn("kinds", F.array_join("kinds", ","))


@query(
    """SELECT user_id, count(*) FILTER (WHERE f = 0) AS n FROM (SELECT user_id, sum(CASE WHEN event_type <> 'purchase' THEN 0 ELSE 1 END)
       OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS f FROM events) GROUP BY user_id"""
)
def group_chain_take_while(t: Tables):
    return t.events.group_by("user_id").chain().order_by("ts").take_while(c("event_type") != "purchase").count("n")


@query("SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_totalprice > 300000) = 1 THEN max(o_orderkey) FILTER (WHERE o_totalprice > 300000) END AS one FROM orders GROUP BY o_custkey")
def group_chain_single_or_null(t: Tables):
    return t.orders.group_by("o_custkey").chain().where(c("o_totalprice") > 300000).single("one", c("o_orderkey"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') > 0 AS hit FROM events GROUP BY user_id")
def group_chain_contains(t: Tables):
    return t.events.group_by("user_id").chain().select("event_type").contains("error", "hit")


@query(
    """SELECT o_custkey, len(list_distinct(list_filter(l, lambda x: x IN ('1-URGENT', '2-HIGH')))) AS i, len(list_distinct(list_filter(l, lambda x: x NOT IN ('1-URGENT', '2-HIGH')))) AS e,
       len(list_distinct(list_concat(l, ['9-NEW']))) AS u, len(l) + 1 AS cc FROM (SELECT o_custkey, list(o_orderpriority) AS l FROM orders GROUP BY o_custkey)"""
)
def group_array_set_ops(t: Tables):
    out = t.orders.group_by("o_custkey").chain().select("o_orderpriority").to_array("l")
    some, new = F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), F.array(F.lit("9-NEW"))
    return out.select("o_custkey", F.size(nested.intersect(c("l"), some)).alias("i"), F.size(nested.except_(c("l"), some)).alias("e"), F.size(nested.union(c("l"), new)).alias("u"), F.size(F.concat("l", new)).alias("cc"))


# -- windows


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) AS dr FROM events")
def window_numbers(t: Tables):
    by_time, by_type = [(c("ts"), False), (c("event_id"), False)], [(c("event_type"), False)]
    out = ordering.number_by(t.events.frame, [c("user_id")], by_time, "rn")
    out = ordering.rank_by(ordering.rank_by(out, [c("user_id")], by_type, "rk"), [c("user_id")], by_type, "dr", dense=True)
    return out.select("event_id", c("rn").cast("long"), "rk", "dr")


@query("SELECT event_id, round(sum(value) OVER w, 4) AS s, CAST(count(*) OVER w AS BIGINT) AS n, round(min(value) OVER w, 6) AS lo, round(max(value) OVER w, 6) AS hi, round(avg(value) OVER w, 8) AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def window_running(t: Tables):
    made = {"s": F.sum("value"), "n": F.count("*"), "lo": F.min("value"), "hi": F.max("value"), "a": F.avg("value")}
    out = ordering.running_by(t.events.frame, [c("user_id")], [(c("ts"), False), (c("event_id"), False)], **made)
    return out.select("event_id", "n", F.round("s", 4).alias("s"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("a", 8).alias("a"))


# -- joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t: Tables):
    return t.orders.join(t.customer, "o_custkey", "c_custkey", o_orderkey="outer.o_orderkey", c_name="inner.c_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def join_inner_filtered(t: Tables):
    inner = t.customer.where(c("c_mktsegment") == "BUILDING").where(c("c_acctbal") > 0)
    return t.orders.join(inner, "o_custkey", "c_custkey", o_orderkey="outer.o_orderkey", c_name="inner.c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def left_join(t: Tables):
    return t.customer.left_join(t.orders.where(c("o_totalprice") > 300000), "c_custkey", "o_custkey", c_custkey="outer.c_custkey", o_orderkey="inner.o_orderkey")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def left_join_labels(t: Tables):
    return t.documents.left_join(t.labels, "doc_id", "doc_id", doc_id="outer.doc_id", quality="inner.quality")


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS s, round(max(o_totalprice), 2) AS m FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def group_join_count_sum(t: Tables):
    return t.customer.group_join(t.orders, "c_custkey", "o_custkey").select("c_custkey", n=F.count("*"), s=F.round(sum_or_zero(c("o_totalprice")), 2), m=F.round(F.max("o_totalprice"), 2))


@query(
    """SELECT c_custkey, o_orderkey AS first, o_orderkey IS NULL AS missing FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) o
       ON c_custkey = o_custkey AND r = 1"""
)
def group_join_first_ordered(t: Tables):
    out = t.customer.group_join(t.orders, "c_custkey", "o_custkey").chain().order_by("o_orderdate").first("first", c("o_orderkey"))
    return out.withColumn("missing", c("first").isNull())


@query(
    """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 30 GROUP BY c_custkey"""
)
def group_join_mixed_capture(t: Tables):
    chain = t.customer.group_join(t.orders, "c_custkey", "o_custkey").chain(capture=("c_acctbal",))
    return chain.where(c("o_totalprice") > c("outer_c_acctbal") * 30).count("n")


@query(
    """SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_totalprice DESC, o_orderkey), '') AS keys FROM customer LEFT JOIN
       (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r BETWEEN 2 AND 3) o ON c_custkey = o_custkey GROUP BY c_custkey"""
)
def group_join_page_array(t: Tables):
    out = t.customer.group_join(t.orders, "c_custkey", "o_custkey").chain().order_by("o_totalprice", descending=True).page(1, 2).select("o_orderkey").to_array("keys")
    return out.withColumn("keys", F.array_join(F.transform("keys", lambda x: x.cast("string")), ","))


@query(
    "SELECT c_custkey, coalesce(c_mktsegment, '') || '/' || count(o_orderkey) AS label, CASE WHEN count(o_orderkey) > 10 THEN 'busy' ELSE 'calm' END AS kind FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment"
)
def group_join_expressions(t: Tables):
    out = t.customer.group_join(t.orders, "c_custkey", "o_custkey").select("c_custkey", "c_mktsegment", n=F.count("*"))
    return out.select("c_custkey", label=strings.concat(c("c_mktsegment"), "/", c("n")), kind=F.when(c("n") > 10, "busy").otherwise("calm"))


@query(
    """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1) o
       ON c_custkey = o_custkey AND o_orderstatus IN ('F', 'O') GROUP BY c_custkey"""
)
def group_join_distinct_by(t: Tables):
    chain = t.customer.group_join(t.orders, "c_custkey", "o_custkey").chain().distinct_by("o_orderpriority")
    return chain.select("o_orderstatus").intersect_by(["F", "O"]).count("n")


@query(
    """SELECT c_custkey, count(o_orderkey) FILTER (WHERE f = 0) AS n FROM customer LEFT JOIN (SELECT *, sum(CASE WHEN o_orderstatus <> 'P' THEN 0 ELSE 1 END)
       OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS f FROM orders) ON c_custkey = o_custkey GROUP BY c_custkey"""
)
def group_join_take_while(t: Tables):
    return t.customer.group_join(t.orders, "c_custkey", "o_custkey").chain().order_by("o_orderdate").take_while(c("o_orderstatus") != "P").count("n")


@query(
    """SELECT c_custkey, coalesce(string_agg(y || '=' || n, ',' ORDER BY y), '') AS years FROM customer LEFT JOIN (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2)
       ON c_custkey = o_custkey GROUP BY c_custkey"""
)
def group_join_group_by(t: Tables):
    out = t.customer.group_join(t.orders, "c_custkey", "o_custkey").chain().group_by(F.year("o_orderdate"), name="years", n=F.count("*"))
    return out.withColumn("years", F.array_join(F.transform("years", lambda x: F.concat_ws("=", x["Key"].cast("string"), x["n"].cast("string"))), ","))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_any(t: Tables):
    return t.customer.where_exists(t.orders.where(c("o_orderstatus") == "P"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_orderstatus = 'O')")
def anti_all(t: Tables):
    return t.customer.where_not_exists(t.orders.where(~(c("o_orderstatus") == "O")), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_labels(t: Tables):
    return t.documents.where_not_exists(t.labels, "doc_id", "doc_id").select("doc_id")


# -- sets


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
def concat(t: Tables):
    return t.nation.select(k="n_nationkey").concat(t.supplier.select(k="s_nationkey"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT -1, 'ELSEWHERE'")
def append_row(t: Tables):
    return t.region.append(r_name="ELSEWHERE")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def except_not_in(t: Tables):
    return t.nation.select("n_nationkey").except_(t.supplier.where(c("s_acctbal") > 5000).select("s_nationkey"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_suppkey > 3 THEN s_nationkey END FROM supplier)")
def except_null_right(t: Tables):
    return t.nation.select("n_nationkey").except_(t.supplier.select(k=F.when(c("s_suppkey") > 3, c("s_nationkey"))))


@query("SELECT c_nationkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def intersect_in(t: Tables):
    return t.customer.select("c_nationkey").intersect(t.supplier.where(c("s_acctbal") < 0).select("s_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def except_by(t: Tables):
    return t.customer.except_by(t.supplier.where(c("s_acctbal") > 8000), "c_nationkey", "s_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def intersect_by(t: Tables):
    return t.customer.intersect_by(t.supplier.where(c("s_acctbal") > 8000), "c_nationkey", "s_nationkey").select("c_custkey")


@query(
    """SELECT k, nation FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY side, k) AS r FROM
       (SELECT 0 AS side, c_custkey AS k, c_nationkey AS nation FROM customer WHERE c_acctbal > 8000 UNION ALL SELECT 1, s_suppkey, s_nationkey FROM supplier)) WHERE r = 1"""
)
def union_by(t: Tables):
    left = Query(t.customer.where(c("c_acctbal") > 8000).select(k="c_custkey", nation="c_nationkey").frame, id="k")
    return left.union_by(t.supplier.select(k="s_suppkey", nation="s_nationkey"), "nation")


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables):
    return t.customer.where(c("c_acctbal") < 0).select(k="c_nationkey").concat(t.supplier.select(k="s_nationkey")).distinct()
