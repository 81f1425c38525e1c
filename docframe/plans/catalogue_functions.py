"""Registered queries: scalar functions, nested values, and the rows that mutations leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import maths, nested, strings, temporal
from docframe.functions.registry import call
from docframe.plans.registry import Tables, query

c = F.col


# -- strings


@query("SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, length(p_name) AS n FROM part")
def str_case_len(t: Tables):
    return t.part.select("p_partkey", lo=strings.to_lower(c("p_name")), up=strings.to_upper(c("p_name")), n=strings.length(c("p_name")).cast("long"))


@query("SELECT p_partkey, contains(p_type, 'E') AS a, contains(lower(p_type), lower('ste')) AS b, starts_with(p_brand, 'Brand#1') AS s, ends_with(p_brand, '3') AS e FROM part")
def str_contains_starts_ends(t: Tables):
    brand, kind = c("p_brand"), c("p_type")
    return t.part.select("p_partkey", a=strings.contains(kind, "E"), b=strings.contains(kind, "ste", True), s=strings.starts_with(brand, "Brand#1"), e=strings.ends_with(brand, "3"))


@query("SELECT p_partkey, CASE WHEN p_brand < 'Brand#3' THEN -1 WHEN p_brand > 'Brand#3' THEN 1 ELSE 0 END AS c, lower(p_brand) = 'brand#12' AS eq FROM part")
def str_compare(t: Tables):
    return t.part.select("p_partkey", c=strings.compare(c("p_brand"), "Brand#3"), eq=strings.equals(c("p_brand"), "BRAND#12", True))


@query("SELECT p_partkey, instr(p_name, 'a') - 1 AS i, instr(lower(p_name), 'e') - 1 AS j FROM part")
def str_index_of(t: Tables):
    return t.part.select("p_partkey", i=strings.index_of(c("p_name"), "a").cast("long"), j=strings.index_of(c("p_name"), "E", True).cast("long"))


@query("SELECT doc_id, substr(text, 3, 10) AS a, substr(text, 21) AS b, substr(text, 5, 1) AS ch FROM documents")
def str_substring_char(t: Tables):
    return t.documents.select("doc_id", a=strings.substring(c("text"), 2, 10), b=strings.substring(c("text"), 20), ch=strings.char_at(c("text"), 4))


@query("SELECT doc_id, concat(lang, CASE WHEN lang <> 'en' THEN source END, '-', doc_id) AS v FROM documents")
def str_concat_null(t: Tables):
    return t.documents.select("doc_id", v=strings.concat(c("lang"), F.when(c("lang") != "en", c("source")), "-", c("doc_id")))


@query("SELECT p_partkey, trim('  ' || p_brand || ' ') AS a, ltrim('  ' || p_brand) AS b, rtrim(p_brand || '  ') || '.' AS d, replace(p_type, 'E', '3') AS r FROM part")
def str_trim_replace(t: Tables):
    b = c("p_brand")
    return t.part.select(
        "p_partkey", a=strings.trim(F.concat(F.lit("  "), b, F.lit(" "))), b=strings.trim_start(F.concat(F.lit("  "), b)), d=F.concat(strings.trim_end(F.concat(b, F.lit("  "))), F.lit(".")), r=strings.replace(c("p_type"), "E", "3")
    )


@query("SELECT doc_id, (v IS NULL OR v = '') AS empty FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN '' WHEN lang <> 'fr' THEN lang END AS v FROM documents)")
def str_null_or_empty(t: Tables):
    v = F.when(c("lang") == "de", "").when(c("lang") != "fr", c("lang"))
    return t.documents.select("doc_id", empty=strings.is_null_or_empty(v))


# -- math


@query("SELECT part.p_partkey, round(sin(x), 9) AS s, round(cos(x), 9) AS co, round(tan(x), 6) AS ta, round(asin(x / 60), 9) AS asi, round(acos(x / 60), 9) AS ac, round(atan(x), 9) AS at, round(atan2(x, 3), 9) AS a2 FROM part, (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS x FROM part) WHERE k = p_partkey")
def math_trig(t: Tables):
    x = c("p_size").cast("double")
    return t.part.select(
        "p_partkey", s=F.round(maths.sin(x), 9), co=F.round(maths.cos(x), 9), ta=F.round(maths.tan(x), 6), asi=F.round(maths.asin(x / 60), 9), ac=F.round(maths.acos(x / 60), 9), at=F.round(maths.atan(x), 9), a2=F.round(maths.atan2(x, F.lit(3.0)), 9)
    )


@query("SELECT p_partkey, round(sinh(x), 6) AS sh, round(cosh(x), 6) AS ch, round(tanh(x), 9) AS th, round(asinh(x), 9) AS ash, round(acosh(x + 1), 9) AS ach, round(atanh(x / 60), 9) AS ath FROM (SELECT p_partkey, p_size / 10.0 AS x FROM part)")
def math_hyperbolic(t: Tables):
    x = c("p_size") / F.lit(10.0)
    return t.part.select(
        "p_partkey", sh=F.round(maths.sinh(x), 6), ch=F.round(maths.cosh(x), 6), th=F.round(maths.tanh(x), 9), ash=F.round(maths.asinh(x), 9), ach=F.round(maths.acosh(x + 1), 9), ath=F.round(maths.atanh(x / 60), 9)
    )


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(ln(s_acctbal), 9) END AS l, CASE WHEN s_acctbal > 0 THEN round(log2(s_acctbal), 9) END AS l2, CASE WHEN s_acctbal > 0 THEN round(log10(s_acctbal), 9) END AS l10, round(exp(s_acctbal / 1000), 4) AS e, round(pow(s_acctbal, 2), 2) AS p, CASE WHEN s_acctbal >= 0 THEN round(sqrt(s_acctbal), 9) END AS r FROM supplier")
def math_log_exp_pow(t: Tables):
    x = c("s_acctbal")
    return t.supplier.select(
        "s_suppkey", l=F.round(maths.log(x), 9), l2=F.round(maths.log2(x), 9), l10=F.round(maths.log10(x), 9), e=F.round(maths.exp(x / 1000), 4), p=F.round(maths.power(x, 2), 2), r=F.round(maths.sqrt(x), 9)
    )


@query("SELECT s_suppkey, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, trunc(s_acctbal) AS tr, round(s_acctbal) AS r0, round(s_acctbal, 1) AS r1 FROM supplier")
def math_round_ceil_floor_trunc(t: Tables):
    x = c("s_acctbal")
    return t.supplier.select("s_suppkey", c=maths.ceiling(x), f=maths.floor(x), tr=maths.truncate(x), r0=maths.round_half_away(x), r1=maths.round_half_away(x, 1))


@query("SELECT s_suppkey, abs(s_acctbal) AS a, CAST(sign(s_acctbal) AS DOUBLE) AS s FROM supplier")
def math_abs_sign(t: Tables):
    return t.supplier.select("s_suppkey", a=maths.absolute(c("s_acctbal")), s=maths.sign(c("s_acctbal")))


@query("SELECT event_id, CASE WHEN v IS NOT NULL THEN least(v, user_id) END AS lo, CASE WHEN v IS NOT NULL THEN greatest(v, user_id) END AS hi FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN event_id % 100 END AS v FROM events)")
def math_min_max_null(t: Tables):
    v = F.when(c("event_id") % 3 > 0, c("event_id") % 100)
    return t.events.select("event_id", lo=maths.smaller(v, c("user_id")), hi=maths.larger(v, c("user_id")))


@query("SELECT p_partkey, round(x - 7.0 * round(x / 7.0), 9) AS r FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)")
def math_ieee_remainder(t: Tables):
    return t.part.select("p_partkey", r=F.round(maths.ieee_remainder(c("p_size").cast("double"), 7.0), 9))


@query("SELECT p_partkey, p_partkey * CAST(p_size AS BIGINT) AS v FROM part")
def math_big_mul(t: Tables):
    return t.part.select("p_partkey", v=maths.big_mul(c("p_partkey"), c("p_size")))


# -- dates and times


@query("SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, epoch_us(ts) // 1000 % 1000 AS ms FROM events")
def dt_members(t: Tables):
    ts = c("ts")
    return t.events.select("event_id", y=temporal.year(ts), mo=temporal.month(ts), d=temporal.day(ts), h=temporal.hour(ts), mi=temporal.minute(ts), s=temporal.second(ts), ms=temporal.millisecond(ts).cast("long"))


@query("SELECT o_orderkey, dayofweek(o_orderdate) AS w, dayofyear(o_orderdate) AS y, date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) AS n FROM orders")
def dt_day_of_week_year(t: Tables):
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", w=temporal.day_of_week(d), y=temporal.day_of_year(d), n=temporal.day_number(d).cast("long"))


@query("SELECT p_partkey, strftime(TRY_CAST('2023-' || lpad(p_size % 14, 2, '0') || '-' || lpad(p_partkey % 33, 2, '0') AS DATE), '%Y-%m-%d') AS d FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)".replace("lpad(p_size % 14,", "lpad(CAST(p_size % 14 AS VARCHAR),").replace("lpad(p_partkey % 33,", "lpad(CAST(p_partkey % 33 AS VARCHAR),"))
def dt_make_date_valid(t: Tables):
    made = temporal.make_date(F.lit(2023), c("p_size") % 14, (c("p_partkey") % 33).cast("int"))
    return t.part.select("p_partkey", d=F.date_format(made, "yyyy-MM-dd"))


@query("SELECT p_partkey, CASE WHEN p_size % 30 < 24 AND p_partkey % 70 < 60 THEN strftime(make_timestamp(2024, 2, 29, p_size % 30 % 24, p_partkey % 70 % 60, 5.25), '%Y-%m-%d %H:%M:%S.%g') END AS v FROM part")
def dt_make_datetime(t: Tables):
    made = temporal.make_datetime(2024, 2, 29, c("p_size") % 30, (c("p_partkey") % 70).cast("int"), 5, 250)
    return t.part.select("p_partkey", v=F.date_format(made, "yyyy-MM-dd HH:mm:ss.SSS"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS s, strftime(ts, '%m/%d/%Y %H:%M:%S') AS g, strftime(ts, '%H:%M') AS t FROM events")
def dt_format_iso(t: Tables):
    ts = c("ts")
    return t.events.select("event_id", s=temporal.format_time(ts, "s"), g=temporal.format_time(ts), t=temporal.format_time(ts, "t"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%A, %d %B %Y') AS a, strftime(o_orderdate, '%a %d-%b-%y') AS b, strftime(o_orderdate, '%I %p') AS p FROM orders")
def dt_format_names(t: Tables):
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", a=temporal.format_time(d, "D"), b=temporal.format_time(d, "ddd dd-MMM-yy"), p=temporal.format_time(d, "hh tt"))


@query("SELECT event_id, ms / 1000.0 AS s, round(ms / 3600000.0, 12) AS h, round(ms / 86400000.0, 12) AS d, ms // 86400000 AS pd, ms // 3600000 % 24 AS ph, ms // 60000 % 60 AS pm, ms // 1000 % 60 AS ps FROM (SELECT event_id, CAST((event_id - 5000) * 7919 AS BIGINT) AS ms FROM events)")
def dt_timespan_totals(t: Tables):
    ms = ((c("event_id") - 5000) * 7919).cast("long")
    part = lambda u: temporal.span_part(ms, u).cast("long")
    return t.events.select("event_id", s=temporal.span_total(ms, "second"), h=F.round(temporal.span_total(ms, "hour"), 12), d=F.round(temporal.span_total(ms, "day"), 12), pd=part("day"), ph=part("hour"), pm=part("minute"), ps=part("second"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def dt_unix_ms(t: Tables):
    return t.events.select("event_id", ms=temporal.unix_milliseconds(c("ts")))


@query("SELECT event_id, CAST(v // 3600000 % 24 AS BIGINT) AS h, CAST(v // 60000 % 60 AS BIGINT) AS m, CAST(v // 1000 % 60 AS BIGINT) AS s FROM (SELECT event_id, CAST(event_id * 8639 % 86400000 AS BIGINT) AS v FROM events)")
def dt_time_members(t: Tables):
    parts = temporal.time_of_day((c("event_id") * 8639 % 86_400_000).cast("long"))
    return t.events.select("event_id", h=parts["hour"].cast("long"), m=parts["minute"].cast("long"), s=parts["second"].cast("long"))


@query("SELECT event_id, strftime(to_timestamp(epoch_ms(ts) // 1000 - 5400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS v FROM events".replace("to_timestamp(epoch_ms(ts) // 1000 - 5400) AT TIME ZONE 'UTC'", "date_trunc('second', ts) - INTERVAL 90 MINUTE"))
def dt_offset(t: Tables):
    at = temporal.make_datetime_offset(F.date_trunc("second", c("ts")), 90)
    return t.events.select("event_id", v=F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


# -- arrays, maps, JSON


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(t: Tables):
    return t.events.select("event_id", k=nested.dyn(nested.parse_json(c("props")), "k", "bigint"))


@query("SELECT event_id, json_extract_string(props, '$.missing') AS missing, json_type(json(props)) = 'OBJECT' AS object FROM events")
def dyn_access(t: Tables):
    v = nested.parse_json(c("props"))
    return t.events.select("event_id", missing=nested.dyn(v, "missing", "string"), object=nested.json_kind(v) == "object")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def dyn_group(t: Tables):
    return t.events.group_by(k=nested.dyn(nested.parse_json(c("props")), "k", "bigint") % 10).select(k="k", n=F.count("*"))


@query("SELECT vec_id, list_any_value(list_filter(embedding, lambda x: x > 0.3)) IS NOT NULL AS any_high, len(list_filter(embedding, lambda x: x < -1)) = 0 AS all_above, list_contains(embedding, embedding[2]) AS has FROM embeddings")
def json_array_any_all(t: Tables):
    e = c("embedding")
    return t.embeddings.select("vec_id", any_high=nested.any_item(e, lambda x: x > F.lit(0.3)), all_above=nested.all_items(e, lambda x: x >= -1), has=nested.contains_item(e, nested.item(e, 1)))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(embedding[1], 5) AS first, embedding[5000] AS beyond FROM embeddings")
def array_index_len(t: Tables):
    e = c("embedding")
    return t.embeddings.select("vec_id", n=nested.count(e).cast("long"), first=F.round(nested.item(e, 0), 5), beyond=nested.item(e, 4999))


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, round(embedding[i], 4) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def array_explode(t: Tables):
    out = t.embeddings.select_many("embedding", "x", "i")
    return out.select("vec_id", i=c("i").cast("long"), x=F.round("x", 4))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_custkey, unnest(string_split(o_orderpriority, '-')) AS part FROM orders) GROUP BY o_custkey")
def array_explode_strings(t: Tables):
    return t.orders.select_many(F.split("o_orderpriority", "-"), "part").group_by("o_custkey").select(o_custkey="o_custkey", n=F.count("*"))


@query("SELECT o_orderkey, o_custkey AS a, CAST(NULL AS BIGINT) AS b FROM orders")
def map_access(t: Tables):
    m = F.create_map(F.lit("cust"), c("o_custkey"), F.lit("key"), c("o_orderkey"))
    return t.orders.select("o_orderkey", a=nested.map_value(m, "cust"), b=nested.map_value(m, "none"))


@query("SELECT o_orderkey, '{\"s\":\"' || o_orderstatus || '\",\"k\":[' || o_custkey || ',' || o_orderkey || ']}' AS j FROM orders")
def json_build(t: Tables):
    made = nested.object_of(s=c("o_orderstatus"), k=nested.array_of(c("o_custkey"), c("o_orderkey")))
    return t.orders.select("o_orderkey", j=F.to_json(made))


@query("SELECT p_partkey, 'x' || p_size AS s, p_brand AS b FROM part")
def json_set_remove(t: Tables):
    made = nested.object_of(size=c("p_size"), brand=c("p_brand"), kind=c("p_type"))
    made = nested.remove_field(nested.set_field(made, "size", F.concat(F.lit("x"), c("p_size").cast("string"))), "kind")
    return t.part.select("p_partkey", made=made).select("p_partkey", s=c("made.size"), b=c("made.brand"))


@query("SELECT doc_id, sha1(lang) AS h, upper(lang) AS u, to_base64(encode(lang)) AS b FROM documents")
def registered_functions(t: Tables):
    return t.documents.select("doc_id", h=call("SHA_HASH", c("lang")), u=call("TO_UPPER", c("lang")), b=call("BASE64", c("lang").cast("binary")))


# -- array edits and time buckets


@query(
    """SELECT o_orderkey, array_to_string([o_custkey, 0, 9], ',') AS app, array_to_string([o_custkey, 7], ',') AS st, array_to_string([0], ',') AS rm, array_to_string([o_custkey, 5, 0], ',') AS ins FROM orders"""
)
def array_append_set_remove_insert(t: Tables):
    a = F.array(c("o_custkey"), F.lit(0).cast("long"))
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    n = lambda v: F.lit(v).cast("long")
    return t.orders.select("o_orderkey", app=text(nested.append(a, n(9))), st=text(nested.set_at(a, 1, n(7))), rm=text(nested.remove_at(a, 0)), ins=text(nested.insert_at(a, 1, n(5))))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def events_hourly(t: Tables):
    out = t.events.frame.groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return out
