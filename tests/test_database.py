import pytest
from pyspark.sql import functions as F

from docframe.errors import Aborted, CastError, InvalidOperation, KeyNotFound, NotSupported, PolicyViolation, RangeError, UniqueViolation, VersionConflict  # noqa: F401
from docframe.functions import nested
from docframe.plans.relations import ToMany, ToOne
from docframe.sources import mongo
from docframe.sources.database import Database
from docframe.sources.files import CHUNK, FileStore
from docframe.streaming.events import apply_to_stream, stream_into
from docframe.types import schema

c = F.col
USER = schema({"Name": "string", "Age": "int32", "Tags": ["string"], "Version": "int64"})


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def names(col):
    return {r.Id: r.Name for r in col.df.collect()}


def test_crud_survives_reopening(spark, db):
    users = db.collection("User", USER)
    assert users.insert({"Name": "a", "Age": 1, "Tags": ["x"]}) == 1
    assert users.insert_batch([{"Name": "b"}, {"Id": 9, "Name": "c"}, {"Name": "d"}]) == [2, 9, 10]
    again = Database(spark, db.source).collection("User")
    assert names(again) == {1: "a", 2: "b", 9: "c", 10: "d"}
    users.update({"Id": 9, "Name": "cc"})
    assert users.update_many(c("Age").isNull(), {"Age": F.lit(7)}, {"Name": F.concat("Name", c("Age").cast("string"))}) == 3
    assert names(users) == {1: "a", 2: "b7", 9: "cc7", 10: "d7"}
    users.upsert_batch([{"Id": 1, "Name": "z"}, {"Id": 1, "Name": "last"}, {"Id": 50, "Name": "new"}])
    assert names(users)[1] == "last" and names(users)[50] == "new"
    assert users.delete(50) == 1 and users.delete(50) == 0 and users.delete_many(c("Age") == 7) == 3
    assert users.replace_many(c("Id") == 1, {"Name": "r"}) == 1 and users.get(1).Tags is None
    assert users.delete_one(F.lit(True)) == 1 and users.df.count() == 0
    for f in (lambda: users.update({"Id": 4}), lambda: users.get(4)):
        with pytest.raises(KeyNotFound):
            f()
    for f in (lambda: users.insert({"Id": -1}), lambda: users.insert_batch([None]), lambda: users.update({"Name": "x"}), lambda: db.collection("a b", USER)):
        with pytest.raises(InvalidOperation):
            f()
    assert db.vacuum() == 0 and db.vacuum(0) > 3 and names(users) == {}


def test_array_edits_and_versions(db):
    users = db.collection("User", USER)
    users.insert({"Name": "a", "Tags": ["p", "q"], "Version": 1})
    users.update_many(F.lit(True), {"Tags": nested.append(c("Tags"), "r")}, {"Tags": nested.insert_at(c("Tags"), 1, "i")}, {"Tags": nested.remove_at(c("Tags"), 0)}, {"Tags": nested.set_at(c("Tags"), 0, "s")})
    assert users.get(1).Tags == ["s", "q", "r"]
    users.update({"Id": 1, "Name": "b", "Version": 2}, version=1, version_field="Version")
    with pytest.raises(VersionConflict):
        users.update({"Id": 1, "Name": "c", "Version": 3}, version=1, version_field="Version")
    with pytest.raises(NotSupported):
        users.update_many(F.lit(True), {"Id": F.lit(3)})


def test_unique_index_and_transactions(spark, db):
    users = db.collection("User", USER)
    users.insert_batch([{"Name": "a", "Age": 1}, {"Name": "b", "Age": 2}])
    users.ensure_index("Name", unique=True)
    with pytest.raises(UniqueViolation):
        users.insert({"Name": "a"})
    with pytest.raises(UniqueViolation):
        users.insert({"Id": 1, "Name": "new"})
    users.upsert({"Name": "a", "Age": 5})
    assert sorted((r.Name, r.Age) for r in users.df.collect()) == [("a", 5), ("b", 2)]
    with pytest.raises(InvalidOperation):
        users.ensure_index("Id")
    with pytest.raises(ZeroDivisionError), db.transaction():
        users.insert({"Name": "gone"})
        assert users.df.count() == 3
        with pytest.raises(KeyError), db.transaction():
            users.insert({"Name": "inner"})
            raise KeyError
        assert users.df.count() == 3
        1 / 0
    assert users.df.count() == 2 and Database(spark, db.source).collection("User").df.count() == 2
    assert db.with_transaction(lambda d: users.insert({"Name": "kept"})) and users.df.count() == 3
    assert users.drop_index("Name") and not users.drop_index("Name")


def test_upsert_of_id_0(spark, db, tmp_path):
    """0 is an id of attached rows, and where a document has it."""
    col = db.attach("A", spark.createDataFrame([(0, "zero"), (1, "one")], "Id int, Name string"))
    col.upsert({"Id": 0, "Name": "z"})
    assert names(col) == {0: "z", 1: "one"}
    items = spark.createDataFrame([(0, "last", 2), (0, "first", 1), (None, "new", 3), (1, "uno", 4)], "Id int, Name string, At int")
    col.upsert_batch(items, last_wins=c("At"))
    assert sorted(map(tuple, col.df.collect())) == [(0, "last"), (1, "uno"), (2, "new")]
    col.delete(0)
    db.backup(str(tmp_path / "copy"))
    copy = Database(spark, str(tmp_path / "copy")).collection("A")
    copy.upsert({"Id": 0, "Name": "back"})
    assert names(copy) == {0: "back", 1: "uno", 2: "new"}
    users = db.collection("User", USER)
    db._put("User", spark.createDataFrame([(0, "old", 1, None, None)], USER))
    users.upsert({"Id": 0, "Name": "new"})
    assert names(users) == {0: "new"}


def test_upsert_without_ids(spark):
    """0 is no id in a collection that numbers its documents, nor in one of the name of attached rows that were dropped; "0" is one."""
    db = Database(spark, "memory:without")
    db.attach("User", spark.createDataFrame([], USER))
    db.drop("User")
    users = db.collection("User", USER)
    users.upsert_batch([{"Id": 0, "Name": "a"}, {"Id": 0, "Name": "b"}, {"Id": 4, "Name": "d"}])
    assert sorted((r.Id, r.Name) for r in users.df.collect()) in ([(4, "d"), (5, "a"), (6, "b")], [(4, "d"), (5, "b"), (6, "a")])
    texts = db.collection("T", schema({"Id": "string", "Name": "string"}, None))
    texts.upsert_batch([{"Id": "a", "Name": "a"}, {"Id": "0", "Name": "first"}, {"Id": "0", "Name": "last"}])
    assert sorted(map(tuple, texts.df.collect())) == [("0", "last"), ("a", "a")]


def test_generated_ids(db):
    kind = schema({"Id": "string", "Data": "string"}, None)
    col = db.collection("Obj", kind, generate=lambda col, item: f"id-{item['Data']}")
    assert col.insert({"Data": "q"}) == "id-q" and col.get("id-q").Data == "q"


def test_policies(db):
    team = db.collection("Team", schema({"Name": "string", "Lead": "ref"}))
    member = db.collection("Member", schema({"Name": "string"}))
    db.relate(ToOne("Team", "Lead", "Member", "Id", on_delete="restrict"))
    db.relate(ToMany("Team", "Members", "Member", "Id", "TeamMembers", on_delete="unlink", on_owner_delete="deletion"))
    lead = member.insert({"Name": "lead"})
    t1 = team.insert_graph({"Name": "one", "Lead": lead, "Members": [{"Name": "m1"}, {"Name": "m2"}]})
    t2 = team.insert_graph({"Name": "two", "Lead": {"Name": "boss"}, "Members": [{"Name": "m3"}]})
    shared = member.df.where("Name = 'm1'").first().Id
    team.link("Members", t2, shared, shared)
    assert db.table("TeamMembers").count() == 4
    with pytest.raises(PolicyViolation):
        member.delete(lead)
    with pytest.raises(PolicyViolation):
        db.drop("Member")
    assert team.update_through(("Lead",), c("Name") == "two", {"Name": F.lit("chief")}) == 1
    assert team.delete(t1) == 1
    assert sorted(r.Name for r in member.df.collect()) == ["chief", "lead", "m1", "m3"]
    assert member.delete(shared) == 1 and db.table("TeamMembers").count() == 1
    team.set_links("Members", t2, [lead])
    assert [tuple(r) for r in db.table("TeamMembers").collect()] == [(t2, lead)]
    db.relate(ToMany("Member", "Friends", "Member", "Id", "MemberFriends"))
    friends = lambda: sorted(tuple(r) for r in db.table("MemberFriends").collect())
    boss = team.get(t2).Lead
    team.link_through(("Lead",), c("Id") == t2, "Friends", lead, boss)
    assert friends() == [(boss, lead), (boss, boss)] or friends() == [(boss, boss), (boss, lead)]
    team.link_through(("Lead",), c("Id") == t2, "Friends", boss, remove=True)
    assert friends() == [(boss, lead)]
    team.link_through(("Lead",), c("Id") == t2, "Friends")
    assert friends() == []
    assert team.set_reference(c("Id") == t2, "Lead", None) == 1 and member.delete_many(c("Name") == "chief") == 1
    assert db.navigate.many(team.query(), "Team", "Members").count("n").first().n == 1
    assert db.names() == ["Member", "MemberFriends", "Team", "TeamMembers"] and db.drop("Team") and not db.drop("Nope", missing_ok=True)


def test_links_of_others_are_not_compared(spark):
    """Of a link table that is read anew, ``link`` takes the links of its owner only, ``set_links`` the others to write them
    only (which counts twice here: for the filter and for the rows)."""
    db = Database(spark, "memory:links")
    db.attach("A", spark.createDataFrame([(1,), (2,)], "Id long"))
    db.attach("B", spark.range(1, 2000).toDF("Id"))
    db.relate(ToMany("A", "Bs", "B", "Id", "AB"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def same(x):
        seen.add(1)
        return x

    def taken(step):
        """The rows of a fresh link table that a step takes, and the links it leaves."""
        links = spark.range(1, 2000).select(F.when(c("id") < 5, 1).otherwise(2).cast("long").alias("SourceId"), same("id").alias("TargetId"))
        db.attach("AB", links, "SourceId")
        before = seen.value
        step(db.collection("A"))
        n = seen.value - before
        return n, sorted(r.TargetId for r in db.table("AB").where("SourceId = 1").collect()), db.table("AB").count()

    n, mine, total = taken(lambda a: a.link("Bs", 1, 3, 9, 9, 4))
    assert n < 100 and mine == [1, 2, 3, 4, 9] and total == 2000
    n, mine, total = taken(lambda a: a.link("Bs", 7, 3, 3))
    assert n < 100 and mine == [1, 2, 3, 4] and total == 2000
    n, mine, total = taken(lambda a: a.set_links("Bs", 1, [4, 2, 8, 2]))
    assert n < 4100 and mine == [2, 4, 8] and total == 1998
    n, mine, total = taken(lambda a: a.set_links("Bs", 1, []))
    assert n < 4100 and mine == [] and total == 1995
    n, mine, total = taken(lambda a: a.set_links("Bs", 1, [1, 2, 3, 4, 5]))
    assert n < 100 and mine == [1, 2, 3, 4, 5] and total == 2000


def test_cascade_and_unlink(spark):
    db = Database(spark, "memory:x")
    a, b = db.collection("A", schema({"B": "ref"})), db.collection("B", schema({"N": "int32"}))
    db.relate(ToOne("A", "B", "B", "Id", on_delete="cascade"))
    b.insert_batch([{"N": 1}, {"N": 2}])
    a.insert_batch([{"B": 1}, {"B": 1}, {"B": 2}, {"B": None}])
    assert b.delete(1) == 1 and sorted(str(r.B) for r in a.df.collect()) == ["2", "None"]


def test_events(db):
    users = db.collection("User", USER)
    seen = []
    db.handlers.on("User", "inserted", lambda ch: seen.append(("in", ch.items.count())))
    db.handlers.on("User", "updated", lambda ch: seen.append((ch.old_items.first().Name, ch.items.first().Name)))
    db.handlers.on("User", "deleting", lambda ch: "remove" if seen.append("once") is None else None)

    def refuse(ch):
        if ch.items.where("Age < 0").count():
            raise ValueError("negative")

    db.handlers.on("User", "inserting", refuse)
    users.insert_batch([{"Name": "a", "Age": 1}, {"Name": "b", "Age": 2}])
    users.update({"Id": 1, "Name": "z"})
    users.delete(1)
    users.delete(2)
    with pytest.raises(Aborted):
        users.insert({"Age": -1})
    assert seen == [("in", 2), ("a", "z"), "once"] and users.df.count() == 0
    assert db.handlers.unregister("User", "inserting", refuse) and not db.handlers.unregister("User", "inserting", refuse)
    with pytest.raises(InvalidOperation):
        db.handlers.on("User", "sometimes", refuse)


def test_untyped_sql_and_backup(spark, db, tmp_path):
    docs = db.untyped("Docs")
    docs.insert_batch([{"Value": '{"a": 1, "b": [true]}'}, {"Value": '"text"'}])
    assert sorted(str(r.a) for r in docs.df.select(nested.dyn(c("Value"), "a", "int").alias("a")).collect()) == ["1", "None"]
    users = db.collection("User", USER)
    users.insert({"Name": "q", "Age": 3})
    assert db.sql("SELECT Name FROM User WHERE Age > :least", least=2).first().Name == "q"
    assert db.sql_first("SELECT Name FROM User WHERE Age > :least", None, least=5) is None
    with pytest.raises(KeyNotFound):
        db.sql_first("SELECT Name FROM User WHERE Age > :least", least=5)
    db.backup(str(tmp_path / "copy"))
    assert Database(spark, str(tmp_path / "copy")).collection("User").get(1).Name == "q"
    db.optimize()
    db.enable_caching()
    assert users.get(1).Name == "q"
    db.disable_caching()


def test_files(spark):
    fs = FileStore(Database(spark, "memory:files"))
    big = bytes(range(256)) * 200
    fs.upload("/a/b/big.bin", big, {"k": "v"})
    fs.upload("/a/small.txt", b"hi")
    assert fs.download("/a/b/big.bin") == big and fs.read_at("a/b/big.bin", CHUNK - 3, 10) == big[CHUNK - 3 : CHUNK + 7]
    fs.write_at("/a/b/big.bin", CHUNK - 2, b"WXYZ")
    want = big[: CHUNK - 2] + b"WXYZ" + big[CHUNK + 2 :]
    assert fs.download("/a/b/big.bin") == want
    fs.write_at("/sparse", 3 * CHUNK + 1, b"end")
    assert fs.download("/sparse") == b"\0" * (3 * CHUNK + 1) + b"end" and fs.chunks.where("path = '/sparse'").count() == 1
    assert [r.name for r in fs.list("/", directories=True).collect()] == ["a"] and fs.count("/") == 2
    assert [r.path for r in fs.list("/a", sort="size", descending=True).collect()] == ["/a/small.txt", "/a/b"]
    fs.set_metadata("/a/small.txt", "x", "1")
    fs.delete_metadata("/a/b/big.bin", "k")
    fs.set_modified("/a/small.txt", 5)
    assert fs.get("/a/small.txt").metadata == {"x": "1"} and fs.get("/a/small.txt").modified == 5 and fs.get("/a/b/big.bin").metadata == {}
    fs.move("/a/b", "/z/moved")
    fs.copy("/a/small.txt", "/z/copy.txt")
    assert fs.download("/z/moved/big.bin") == want and not fs.exists("/a/b/big.bin") and fs.download("/z/copy.txt") == b"hi"
    with pytest.raises(InvalidOperation):
        fs.copy("/a/small.txt", "/z/copy.txt")
    assert [r.path for r in fs.walk("/z").collect()] == ["/z", "/z/copy.txt", "/z/moved", "/z/moved/big.bin"]
    assert {r.path: bytes(r.content) for r in fs.contents().collect()}["/z/moved/big.bin"] == want
    assert fs.delete("/z") and not fs.delete("/z") and fs.chunks.where("path like '/z%'").count() == 0
    with pytest.raises(KeyNotFound):
        fs.download("/none")


def test_facade(spark):
    col = mongo.MongoClient(spark, "memory:").get_database("m").get_collection("U", schema({"Name": "string", "Age": "int32"}))
    col.insert_many([{"Name": "a", "Age": 1}, {"Name": "b", "Age": 5}])
    f = mongo.Filter
    assert col.count_documents(f.empty()) == 2 and col.count_documents(f.gt("Age", 2) & f.eq("Name", "b")) == 1
    assert col.count_documents(f.in_("Name", [])) == 0 and col.count_documents(mongo.QueryBuilder.LT("Age", 2)) == 1
    assert col.replace_one(f.eq("Name", "a"), {"Name": "c", "Age": 9}) == 1 and col.delete_many(f.gt("Age", 8)) == 1
    doc = mongo.BsonDocument(col.find().first())
    assert doc["Name"].as_string == "b" and doc["Age"].to_double() == 5.0 and doc["Age"].is_int and "Nope" not in doc
    with pytest.raises(CastError):
        doc["Name"].as_int
    with pytest.raises(CastError):
        doc["Name"].to_int()


def test_streaming(spark, db, tmp_path):
    users = db.collection("User", USER)
    spark.createDataFrame([(0, "s", 4, None, None), (0, "t", 1, None, None)], USER).write.parquet(str(tmp_path / "in"))
    stream = apply_to_stream(spark.readStream.schema(USER).parquet(str(tmp_path / "in")), lambda q: q.where(c("Age") > 2))
    stream_into(stream, users, str(tmp_path / "check")).awaitTermination(120)
    assert names(users) == {1: "s"}
    users.write_batch(users.df, 0)
    assert users.df.count() == 1
