import pytest
from pyspark.sql import functions as F

from docframe.errors import InvalidOperation, NotSupported
from docframe.plans.query import Query
from docframe.plans.relations import Navigator, RelationCatalog, ToMany, ToOne

c = F.col


@pytest.fixture(scope="module")
def nav(spark):
    tables = {
        "team": spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 99)], "id long, name string, lead long"),
        "member": spark.createDataFrame([(10, "x", 5), (11, "y", None), (12, "z", 7)], "id long, name string, score int"),
        "link": spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10)], "SourceId long, TargetId long"),
    }
    catalog = RelationCatalog().add(ToOne("team", "lead", "member", "id")).add(ToMany("team", "members", "member", "id", "link"))
    return Navigator(catalog, tables.__getitem__, {"team": "id", "member": "id"})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_references(nav):
    q = nav.reference(nav.query("team"), "team", "lead")
    assert rows(q.select("id", "lead_name").frame) == [(1, "x"), (2, None), (3, None)]
    again = nav.reference(q, "team", "lead")
    assert again.frame.columns == q.frame.columns
    with pytest.raises(NotSupported):
        nav.reference(q, "team", "name")
    with pytest.raises(NotSupported):
        nav.reference(q, "team", *["lead"] * 11)


def test_many_filters(nav):
    team = nav.query("team")
    keys = lambda q: sorted(r.id for r in q.to_list())
    assert keys(nav.where_any(team, "team", "members")) == [1, 2]
    assert keys(nav.where_any(team, "team", "members", c("score") > 6)) == [1]
    assert keys(nav.where_all(team, "team", "members", c("score") > 4)) == [1, 2, 3]
    assert keys(nav.where_all(team, "team", "members", c("score") > 5)) == [3]
    assert keys(nav.where_contains(team, "team", "members", 11)) == [1]


def test_many_chains(nav):
    chain = lambda: nav.many(nav.query("team"), "team", "members")
    assert rows(chain().count("n")) == [(1, 3), (2, 1), (3, 0)]
    assert rows(chain().sum("s", c("score"))) == [(1, 12), (2, 5), (3, 0)]
    assert rows(chain().max("m", c("score"))) == [(1, 7), (2, 5), (3, None)]
    assert rows(chain().select("name").to_array("xs")) == [(1, ["x", "y", "z"]), (2, ["x"]), (3, [])]
    assert rows(chain().order_by("score", descending=True).skip(1).select("name").to_array("xs")) == [(1, ["x", "y"]), (2, []), (3, [])]
    assert rows(chain().single("one", c("name"))) == [(1, None), (2, "x"), (3, None)]
    assert rows(chain().max_by("score", "top", c("name"))) == [(1, "z"), (2, "x"), (3, None)]
    assert rows(chain().select("name").default_if_empty("-", "xs")) == [(1, ["x", "y", "z"]), (2, ["x"]), (3, ["-"])]
    assert rows(chain().select("score").intersect([5, None]).count("n")) == [(1, 2), (2, 1), (3, 0)]
    assert rows(chain().select("score").except_([5]).count("n")) == [(1, 2), (2, 0), (3, 0)]
    assert rows(chain().select("score").contains(None, "has")) == [(1, True), (2, False), (3, False)]
    assert rows(chain().contains_entity(12, "has")) == [(1, True), (2, False), (3, False)]
    assert rows(chain().order_by("id").take_while(c("score") > 1).count("n")) == [(1, 1), (2, 1), (3, 0)]
    assert rows(chain().order_by("id").skip_while(c("score") > 1).count("n")) == [(1, 2), (2, 0), (3, 0)]
    for f in (lambda: chain().take_while(c("score") > 1), lambda: chain().skip(1).take(1), lambda: chain().zip(), lambda: chain().distinct(), lambda: chain().of_type("x")):
        with pytest.raises(NotSupported):
            f()


def test_flatten_and_include(nav):
    assert rows(nav.flatten(nav.query("team"), "team", "members").select("id", "members_name").frame) == [(1, "x"), (1, "y"), (1, "z"), (2, "x")]
    whole = {r.id: r for r in nav.include(nav.query("team"), "team", "lead", "members").to_list()}
    assert whole[1].lead_value.name == "x" and whole[3].lead_value is None
    assert [m.name for m in whole[1].members] == ["x", "y", "z"] and whole[3].members == []
    with pytest.raises(NotSupported):
        nav.include(nav.query("team"), "team", "lead", exclude=("lead",))
    with pytest.raises(NotSupported):
        nav.include(nav.query("team"), "team", "lead.x", exclude=("lead",))


def test_catalog_checks():
    catalog = RelationCatalog().add(ToOne("a", "r", "b", "id"))
    catalog.add(ToOne("a", "r", "b", "id"))
    for bad in (ToOne("a", "r", "c", "id"), ToOne("a", "q", "b", "id", on_delete="drop"), ToOne("a", "q", "b", "id", on_delete="deletion"), ToOne("a", "q", "a", "id", on_owner_delete="cascade")):
        with pytest.raises(InvalidOperation):
            catalog.add(bad)


def test_query_needs_id(nav):
    with pytest.raises(InvalidOperation):
        nav.many(Query(nav.tables("team")), "team", "members")
