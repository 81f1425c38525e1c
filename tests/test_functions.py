import datetime as dt

import pytest
from pyspark.sql import functions as F

from docframe.errors import NotSupported, RangeError
from docframe.functions import maths, nested, registry, strings, temporal
from docframe.types import polymorphic, schema, spark_type

c = F.col


def one(spark, *cols, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return tuple(df.select(*(x.alias(f"c{i}") for i, x in enumerate(cols))).first())


def test_strings(spark):
    s = c("s")
    assert one(spark, strings.length(s), strings.char_at(s, 1), strings.index_of(s, "c"), strings.index_of(s, "zz"), strings.ends_with(s, ""), s="é😀c") == (3, "😀", 2, -1, False)
    assert one(spark, strings.trim(s), strings.substring(s, 1, 2), strings.like(s, "%A_B"), s=" \tab ")[:2] == ("\tab", "\ta")
    assert one(spark, strings.concat(s, 1, F.lit(None)), strings.format_string("{0}-{1}!", s, 2), strings.like(s, "AB%"), strings.is_match(F.lit(None).cast("string"), "x"), s="abc") == ("abc1", "abc-2!", True, False)
    assert one(spark, strings.compare(s, "b"), strings.compare(s, "A", True), strings.equals(s, "A", True), strings.is_null_or_empty(s), s="a") == (-1, 0, True, False)


def test_maths(spark):
    x = c("x")
    assert one(spark, maths.sqrt(x), maths.asin(x), maths.acosh(x), maths.log(x), maths.divide(x, 0.0), maths.modulo(x, 0.0), x=-4.0) == (None,) * 6
    assert one(spark, maths.truncate(x), maths.ceiling(x), maths.floor(x), maths.round_half_away(x), x=-2.5) == (-2.0, -2.0, -3.0, -3.0)
    assert one(spark, maths.int_divide(x, -2), maths.modulo(x, 3), maths.int_divide(x, 0), x=-7) == (3, -1, None)
    assert one(spark, maths.smaller(x, F.lit(None).cast("int")), maths.larger(x, 9), x=3) == (None, 9)
    assert one(spark, maths.parse(c("s"), "int32"), maths.parse(F.lit("x1")), maths.to_int(F.lit(2.9)), s=" 12 ") == (12, None, 2)
    assert one(spark, maths.ieee_remainder(x, 3.0), x=11.0) == (-1.0,)


def test_dates(spark):
    assert one(spark, temporal.make_date(2024, 2, 29), temporal.make_date(2023, 2, 29), temporal.make_date(2023, 13, 1), temporal.make_date(2023, 4, 0)) == (dt.date(2024, 2, 29), None, None, None)
    assert one(spark, temporal.make_datetime(2024, 1, 2, 3, 4, 5, 6), temporal.make_datetime(2024, 1, 2, 24)) == (dt.datetime(2024, 1, 2, 3, 4, 5, 6000), None)
    d = c("d")
    assert one(spark, temporal.day_of_week(d), temporal.day_of_year(d), temporal.day_number(d), d=dt.date(2024, 12, 29)) == (0, 364, 739248)
    ms = temporal.make_span(0, 0, -90, -1, -5)
    assert one(spark, temporal.span_part(ms, "hour"), temporal.span_part(ms, "minute"), temporal.span_part(ms, "second"), temporal.span_part(ms, "millisecond"), temporal.span_total(ms, "minute")) == (-1, -30, -1, -5, -5401005 / 60000)
    assert one(spark, temporal.make_time(23, 59), temporal.make_time(24, 0)) == (86_340_000, None)
    ticks = F.lit(638_396_640_000_000_000 + 12345)
    assert one(spark, temporal.datetime_from_ticks(ticks)) == (dt.datetime(2024, 1, 1, 0, 0, 0, 1234),)
    assert one(spark, F.date_format(temporal.make_datetime_offset(F.lit(dt.datetime(2024, 1, 1, 1)).cast("timestamp_ntz"), 120), "dd HH"), temporal.make_datetime_offset(F.current_timestamp(), 15 * 60)) == ("31 23", None)


def test_formats(spark):
    ts = F.lit(dt.datetime(2024, 3, 5, 14, 7, 9, 120300)).cast("timestamp_ntz")
    made = lambda p: one(spark, temporal.format_time(ts, p))[0]
    want = {
        "d": "03/05/2024", "D": "Tuesday, 05 March 2024", "G": "03/05/2024 14:07:09", "s": "2024-03-05T14:07:09", "u": "2024-03-05 14:07:09Z", "o": "2024-03-05T14:07:09.1203000",
        "R": "Tue, 05 Mar 2024 14:07:09 GMT", "M": "March 05", "Y": "2024 March", "t": "14:07", "yy-M-d h:m:s tt": "24-3-5 2:7:9 PM", "ddd MMM 'it''s' \\d": "Tue Mar its d",
        "HH.fff|FFFFF|t": "14.120|1203|P", "%d": "5", "yyyyy": "02024",
    }
    assert {p: made(p) for p in want} == want
    for bad in ("zzz", "HH zz"):
        with pytest.raises(NotSupported):
            temporal.format_time(ts, bad)
    with pytest.raises(NotSupported):
        temporal.format_time(c("d"), "HH:mm", "date")
    with pytest.raises(NotSupported):
        temporal.format_time(c("t"), "yyyy", "time")
    with pytest.raises(NotSupported):
        temporal.format_time(ts, ts)
    with pytest.raises(NotSupported):
        temporal.comparable("date", "datetime")


def test_nested(spark):
    a = F.array(F.lit(1), F.lit(2), F.lit(3))
    assert one(spark, nested.set_at(a, 1, 9), nested.remove_at(a, 0), nested.insert_at(a, 1, 7), nested.insert_at(a, 3, 7), nested.insert_at(a, 0, 7), nested.append(a, 4)) == ([1, 9, 3], [2, 3], [1, 7, 2, 3], [1, 2, 3, 7], [7, 1, 2, 3], [1, 2, 3, 4])
    with pytest.raises(RangeError):
        nested.insert_at(a, -1, 0)
    with pytest.raises(NotSupported):
        nested.item(a, F.lit(1))
    assert one(spark, nested.item(a, 5), nested.contains_item(F.array(F.lit(None), F.lit(1)), None), nested.in_list(F.lit(1), []), nested.any_item(a), nested.all_items(a, lambda x: x > 0)) == (None, True, False, True, True)
    o = nested.object_of(a=1, b=nested.object_of(t=F.array(F.lit("x"))))
    assert one(spark, nested.equals_object(o, {"a": 1, "b": {"t": ["x"]}}), nested.equals_object(o, {"a": 1, "b": {"t": ["x", "y"]}}), nested.equals_object(F.lit(None).cast("int"), None)) == (True, False, True)
    v = nested.parse_json(F.lit('{"a": {"b": [1, "x", null]}, "n": 5}'))
    assert one(spark, nested.dyn(v, "n", "int"), nested.dyn(v, "a.b[1]"), nested.dyn(v, "a.b[1]", "int"), nested.dyn(v, "zz"), nested.json_kind(v)) == (5, "x", None, None, "object")
    assert one(spark, nested.parse_json(F.lit("{bad")).isNull(), nested.map_value(F.create_map(F.lit("k"), F.lit(1)), "q")) == (True, None)


def test_registry_and_types(spark):
    registry.register("twice", lambda x: x * 2)
    assert one(spark, registry.call("TWICE", F.lit(4)), registry.call("DECIMAL_TEXT", F.lit("1.500")), registry.call("to_upper", F.lit("a"))) == (8, "1.5", "A")
    registry.unregister("twice")
    with pytest.raises(NotSupported):
        registry.call("twice", F.lit(1))
    registry.on_unknown(lambda name, *args: F.lit(name) if name == "echo" else None)
    assert one(spark, registry.call("echo")) == ("echo",)
    assert spark_type(["int32?"]).simpleString() == "array<int>" and spark_type({"map": "decimal"}).simpleString() == "map<string,decimal(38,18)>"
    assert schema({"Name": "string", "At": ("int64", "dateonly")}).simpleString() == "struct<Id:bigint,Name:string,At:struct<Item1:bigint,Item2:date>>"
    assert polymorphic({"Color": "string"}, {"Radius": "float64"}, {"Width": "float64"}).names == ["Id", "_type", "Color", "Radius", "Width"]
    with pytest.raises(NotSupported):
        spark_type("option<int>")
