import pytest
from pyspark.sql import functions as F

from docframe.errors import CardinalityError, InvalidOperation, NotSupported, RangeError
from docframe.plans.query import Query, sum_or_zero

c = F.col


@pytest.fixture(scope="module")
def nums(spark):
    rows = [(1, 1, 2.0), (2, None, 5.0), (3, 1, None), (4, 2, -1.0), (5, 2, 0.0), (6, None, None)]
    return Query(spark.createDataFrame(rows, "id long, k int, v double"), id="id")


def ids(q):
    return [r.id for r in q.to_list()]


def test_order_paging_and_elements(nums):
    q = nums.order_by("v")
    assert ids(q.then_by("id")) == [3, 6, 4, 5, 1, 2]
    assert ids(nums.order_by_descending("v").then_by("id"))[-2:] == [3, 6]
    assert ids(nums.order_by("id").take(4).skip(2)) == [3, 4]
    assert ids(nums.order_by("id").skip(1).take(2)) == [2, 3]
    assert nums.order_by("v").then_by("id").element(2).id == 4
    assert nums.last_row().id == 6 and nums.order_by("v").last_row().id == 2
    assert nums.element_or_default(99) is None
    with pytest.raises(CardinalityError):
        nums.element(99)
    with pytest.raises(RangeError):
        nums.element_at(-1)
    with pytest.raises(InvalidOperation):
        nums.then_by("v")
    shown = nums.order_by_descending("id").select("v").take(2)
    assert [r.v for r in shown.to_list()] == [None, 0.0] and shown.df.columns == ["v"]


def test_single_and_first(nums):
    assert nums.single(c("id") == 2).k is None
    assert nums.first_or_default(c("id") > 9, "none") == "none"
    for f, p in ((nums.single, c("k") == 1), (nums.single, c("id") > 9), (nums.first, c("id") > 9), (nums.single_or_default, c("k") == 1)):
        with pytest.raises(CardinalityError):
            f(p)
    assert nums.single_or_default(c("id") > 9) is None


def test_aggregates(nums):
    assert nums.count() == 6 and nums.count(c("v") > 0) == 2
    assert nums.sum("v") == 6.0 and nums.where(F.lit(False)).sum("v") == 0
    assert nums.average("v") == 1.5 and nums.min("v") == -1 and nums.max("v") == 5
    for f in (nums.where(c("v").isNull()).average, nums.where(F.lit(False)).min):
        with pytest.raises(CardinalityError):
            f("v")
    assert not nums.all(c("v") > -5) and nums.where(c("v").isNotNull()).all(c("v") > -5)
    assert nums.any(c("v") > 4) and not nums.where(F.lit(False)).any() and nums.contains("k", 2) and nums.contains("k", None)
    assert nums.min_by("v").first().id == 3 and nums.max_by("v").first().id == 2
    assert nums.where(F.lit(False)).aggregate(s=sum_or_zero(c("v"))).first().s == 0


def test_take_and_skip_while(spark, nums):
    flags = Query(spark.createDataFrame([(1, 1, True), (2, 2, True), (3, 3, None), (4, 4, False), (5, 5, True)], "id long, ord int, p boolean"), id="id")
    assert sorted(ids(flags.order_by("ord").take_while(c("p")))) == [1, 2]
    assert sorted(ids(flags.order_by("ord").skip_while(c("p")))) == [3, 4, 5]
    assert sorted(ids(flags.order_by_descending("ord").take_while(c("p")))) == [5]
    assert sorted(ids(nums.order_by("v").take_while(c("v").isNull() | (c("v") < 1)))) == [3, 4, 5, 6]
    assert ids(flags.order_by("ord").take_while(F.lit(True))) == [1, 2, 3, 4, 5] and flags.order_by("ord").skip_while(F.lit(True)).count() == 0
    with pytest.raises(InvalidOperation):
        flags.take_while(c("p"))


def test_distinct_and_sets(spark, nums):
    assert sorted(ids(nums.distinct_by("k"))) == [1, 2, 4]
    assert {(r.Key, r.Value) for r in nums.count_by("k").to_list()} == {(1, 2), (2, 2), (None, 2)}
    left = Query(spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "v int"))
    right = Query(spark.createDataFrame([(2,), (4,)], "v int"))
    nulls = Query(spark.createDataFrame([(2,), (None,)], "v int"))
    values = lambda q: sorted((r.v for r in q.to_list()), key=str)
    assert values(left.except_(right)) == [1, 1, 3] and values(left.except_(nulls)) == []
    assert values(left.except_(right.where(F.lit(False)))) == [1, 1, 2, 3, None]
    assert values(left.intersect(right)) == [2] and values(left.concat(right)) == [1, 1, 2, 2, 3, 4, None]
    a = Query(spark.createDataFrame([(5, "x"), (2, "x")], "id long, k string"), id="id")
    b = Query(spark.createDataFrame([(1, "x"), (1, "y")], "id long, k string"), id="id")
    assert sorted(tuple(r) for r in a.union_by(b, "k").to_list()) == [(1, "y"), (2, "x")]
    assert [tuple(r) for r in a.append(k="z").where(c("k") == "z").to_list()] == [(-1, "z")]
    empty = a.where(F.lit(False)).default_if_empty(k="d")
    assert [tuple(r) for r in empty.to_list()] == [(None, "d")] and a.default_if_empty(k="d").count() == 2


def test_projected_distinct_keeps_order(nums):
    out = nums.order_by_descending("id").select("k").distinct()
    assert [r.k for r in out.to_list()] == [None, 2, 1]


def test_groups(nums):
    g = nums.group_by("k").select(k="k", n=F.count("*"), s=sum_or_zero(c("v")))
    assert {tuple(r) for r in g.to_list()} == {(1, 2, 2.0), (2, 2, -1.0)}
    assert nums.group_by("k", drop_nulls=False).select(k="k", n=F.count("*")).count() == 3
    assert {tuple(r) for r in nums.group_by("k").having(F.max("v") > 1).select(k="k").to_list()} == {(1,)}
    items = {r.Key: [i.id for i in r.Items] for r in nums.group_by("k").items().to_list()}
    assert items == {1: [1, 3], 2: [4, 5]}
    chain = nums.group_by("k", drop_nulls=False).chain()
    assert {(r.k, r.n) for r in chain.where(c("v") > 0).count("n").collect()} == {(1, 1), (2, 0), (None, 1)}
    assert {(r.k, r["first"]) for r in chain.order_by("v", descending=True).first("first", c("id")).collect()} == {(1, 1), (2, 5), (None, 2)}
    assert {(r.k, r.one) for r in chain.where(c("v").isNotNull()).single("one", c("id")).collect()} == {(1, 1), (2, None), (None, 2)}
    assert {(r.k, r.a) for r in chain.all(c("v") > -5, "a").collect()} == {(1, False), (2, True), (None, False)}
    assert {(r.k, r.a) for r in chain.all(c("v") > -5, "a", nulls_pass=True).collect()} == {(1, True), (2, True), (None, True)}
    with pytest.raises(NotSupported):
        chain.take(1).take(1)
    with pytest.raises(NotSupported):
        chain.min_by("v")


def test_joins(spark, nums):
    other = Query(spark.createDataFrame([(10, 1), (11, 1), (12, None)], "oid long, k int"), id="oid")
    assert {tuple(r) for r in nums.join(other, "k", "k", id="outer.id", oid="inner.oid").to_list()} == {(1, 10), (1, 11), (3, 10), (3, 11)}
    assert nums.left_join(other, "k", "k").count() == 8
    out = nums.group_join(other, "k", "k").select("id", n=F.count("*"), m=F.max("oid"))
    assert {tuple(r) for r in out.to_list()} == {(1, 2, 11), (2, 0, None), (3, 2, 11), (4, 0, None), (5, 0, None), (6, 0, None)}
    with pytest.raises(NotSupported):
        nums.join(other, ("k", "id"), ("k", "oid"))
    with pytest.raises(NotSupported):
        nums.join(other, "k", "k", comparer=1)


def test_types_and_refusals(spark, nums):
    shapes = Query(spark.createDataFrame([(1, "Circle", 2.0), (2, "Square", None), (3, None, None)], "id long, _type string, radius double"), id="id")
    assert ids(shapes.of_type("Circle")) == [1]
    assert ids(shapes.where(c("id") == 1).cast("Circle")) == [1]
    with pytest.raises(Exception, match="CastError"):
        shapes.cast("Circle").to_list()
    with pytest.raises(NotSupported):
        nums.of_type("x")
    for name in ("reverse", "zip", "prepend", "sequence_equal"):
        with pytest.raises(NotSupported):
            getattr(nums, name)()
    with pytest.raises(NotSupported):
        nums.aggregate_fold()
    arrays = Query(spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "id long, a array<int>"), id="id")
    assert [tuple(r)[0::2] for r in arrays.select_many("a").to_list()] == [(1, 1), (1, 2)]
    with pytest.raises(NotSupported):
        arrays.with_column("b", F.lit(b"x")).select_many("b")


def test_explain_and_group_join_chain(spark, nums):
    assert "Filter" in nums.where(c("k") == 1).explain()
    other = Query(spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "oid long, k int"), id="oid")
    chain = nums.where(c("id") < 5).group_join(other, "k", "k").chain()
    assert sorted((r.id, r.items) for r in chain.select("oid").union([11, 99]).collect()) == [(1, [10, 11, 99]), (2, [11, 99]), (3, [10, 11, 99]), (4, [12, 11, 99])]
    assert sorted((r.id, r.a) for r in chain.all(F.when(c("oid") > 10, True), "a").collect()) == [(1, False), (2, True), (3, False), (4, True)]
    assert sorted((r.id, r.xs) for r in chain.select("oid").default_if_empty(0, "xs").collect())[1] == (2, [0])
