"""Databases and collections: document tables with ids, mutations, transactions, relations and events."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from docframe.errors import InvalidOperation, KeyNotFound, NotSupported, PolicyViolation, UniqueViolation, VersionConflict, WriteConflict
from docframe.plans.query import Query
from docframe.plans.relations import Navigator, RelationCatalog, ToMany, ToOne
from docframe.session import cut
from docframe.sources import storage as stored
from docframe.sources.storage import Storage
from docframe.streaming.events import Change, Handlers

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
#: Directories that a table may consist of before an insert rewrites it.
PARTS = 64


class Database:
    """``Database(spark, "memory:name")`` keeps tables for the session; any other source is a directory.

    A table is a list of parts (directories, or DataFrames in memory); inserts add one, other changes
    replace them all. Tables, indexes, relations, ids and the marks of streams are sections of one
    manifest, and change together or not at all. Outside a transaction every access sees the latest
    commit of any handle; a commit fails with WriteConflict if another one changed the same
    table since its transaction began."""

    def __init__(self, spark: SparkSession, source: str) -> None:
        self.spark, self.source = spark, source
        self.storage = None if source.startswith("memory:") else Storage(spark, source)
        self.handlers, self.caching = Handlers(), False
        self._base: dict[str, Any] = self.storage.read_manifest() if self.storage else stored.empty()
        self._staged: list[dict[tuple[str, str], Any]] = []

    # -- what the manifest holds

    def _section(self, name: str) -> dict[str, Any]:
        """A section as it is now: the latest commit's, with what is staged."""
        if self.storage and not self._staged:
            self._base = self.storage.read_manifest()
        out = dict(self._base[name])
        for layer in self._staged:
            out.update({k: v for (s, k), v in layer.items() if s == name})
        return {k: v for k, v in out.items() if v is not None}

    def _set(self, section: str, key: str, value: Any) -> None:
        """Stage an entry (None: remove it); outside a transaction it is committed at once."""
        with self.transaction():
            self._staged[-1][section, key] = value

    def _commit(self, layer: dict[tuple[str, str], Any]) -> None:
        base = self._base
        while True:
            latest = self.storage.read_manifest() if self.storage else base
            for section, key in layer:
                if latest[section].get(key) is not base[section].get(key) and latest[section].get(key) != base[section].get(key):
                    raise WriteConflict(f"{key}: another writer changed its {section}")
            fresh = latest | {"number": latest["number"] + 1} | {s: dict(latest[s]) for s in stored.SECTIONS}
            for (section, key), value in layer.items():
                if value is None:
                    fresh[section].pop(key, None)
                else:
                    fresh[section][key] = value
            if not self.storage or self.storage.create_manifest(fresh):
                self._base = fresh
                return

    @contextmanager
    def transaction(self):
        """Changes inside are seen inside, and committed together at the end or dropped on an error. A transaction within
        another only drops its own changes."""
        if self.storage and not self._staged:
            self._base = self.storage.read_manifest()
        self._staged.append({})
        try:
            yield self
        except BaseException:
            self._staged.pop()
            raise
        layer = self._staged.pop()
        if self._staged:
            self._staged[-1].update(layer)
        elif layer:
            self._commit(layer)

    def with_transaction(self, f: Callable[[Database], Any]) -> Any:
        with self.transaction():
            return f(self)

    # -- tables

    def table(self, name: str) -> DataFrame:
        parts = self._section("tables").get(name)
        if parts is None:
            raise KeyNotFound(f"no collection {name!r}")
        return self.storage.read(parts) if self.storage else reduce(DataFrame.union, parts)

    def _put(self, name: str, df: DataFrame | None) -> None:
        """A table's new rows (None: drop it)."""
        self._set("tables", name, None if df is None else [self.storage.write(name, df) if self.storage else cut(df)])

    def _append(self, name: str, fresh: DataFrame) -> None:
        """More rows of a table; only they are written, unless it has very many parts."""
        parts = self._section("tables")[name]
        if len(parts) >= PARTS:
            self._put(name, self.table(name).unionByName(fresh).hint("rebalance"))
        else:
            self._set("tables", name, [*parts, self.storage.write(name, fresh) if self.storage else cut(fresh)])

    @property
    def ids(self) -> dict[str, str]:
        """The id field of each collection."""
        return self._section("ids")

    @property
    def relations(self) -> RelationCatalog:
        out = RelationCatalog()
        for r in self._section("relations").values():
            out.add((ToOne if r["kind"] == "one" else ToMany)(**{k: v for k, v in r.items() if k != "kind"}))
        return out

    # -- collections

    def collection(self, name: str, schema: T.StructType | None = None, id: str | None = None, generate: Callable | None = None) -> Collection:
        """A typed handle; the collection is created if it doesn't exist. ``id`` is the id field, "Id" for a new one."""
        if not _NAME.match(name):
            raise InvalidOperation(f"not a collection name: {name!r}")
        known = self.ids.get(name)
        if known and id not in (None, known):
            raise InvalidOperation(f"the id of {name} is {known}")
        id = known or id or "Id"
        if not self.exists(name):
            if schema is None:
                raise KeyNotFound(f"no collection {name!r}")
            with self.transaction():
                self._put(name, self.spark.createDataFrame([], schema))
                self._set("ids", name, id)
        return Collection(self, name, id, generate)

    def untyped(self, name: str) -> Collection:
        """A collection of (Id, Value) with schemaless values."""
        return self.collection(name, T.StructType([T.StructField("Id", T.LongType()), T.StructField("Value", T.VariantType())]))

    def attach(self, name: str, df: DataFrame, id: str = "Id") -> Collection:
        """Existing rows (a table, Parquet or JSON that was read), with their ids, as a collection: as they are in a database in
        memory, as a copy in a directory."""
        with self.transaction():
            self._set("tables", name, [df if self.storage is None else self.storage.write(name, df)])
            self._set("ids", name, id)
            self._set("attached", name, True)
        return Collection(self, name, id, None)

    def exists(self, name: str) -> bool:
        return name in self._section("tables")

    def names(self) -> list[str]:
        return sorted(self._section("tables"))

    def drop(self, name: str, missing_ok: bool = False) -> bool:
        if not self.exists(name):
            if missing_ok:
                return False
            raise KeyNotFound(f"no collection {name!r}")
        inbound = [r for r in self.relations.inbound(name) if r.owner != name and self.exists(r.owner)]
        if inbound:
            raise PolicyViolation(f"{name} is the target of {inbound[0].owner}")
        with self.transaction():
            self._put(name, None)
            for r in self.relations.outbound(name):
                self._set("relations", ".".join(r.key), None)
            for section in ("ids", "indexes", "attached"):
                self._set(section, name, None)
        return True

    def relate(self, relation: ToOne | ToMany) -> None:
        """Record a relation with the database. One that is known may get other policies; a reference may become a to-many
        relation with a link table, which takes over its links. Any other change of a known relation is refused."""
        RelationCatalog().add(relation)  # checks its policies
        known, name = self._section("relations").get(".".join(relation.key)), ".".join(relation.key)
        fresh = asdict(relation) | {"kind": "one" if isinstance(relation, ToOne) else "many"}
        evolves = known is not None and known["kind"] == "one" and isinstance(relation, ToMany) and bool(relation.links)
        parts = lambda r: {k: v for k, v in r.items() if not k.startswith("on_")}
        if known is not None and not evolves and parts(known) != parts(fresh):
            raise InvalidOperation(f"conflicting definitions of {name}")
        if evolves and known["target"] != relation.target:
            raise InvalidOperation(f"{name} can't move to another target")
        with self.transaction():
            if isinstance(relation, ToMany) and relation.links and not self.exists(relation.links):
                kind = T.StructType([T.StructField(relation.source_field, T.LongType()), T.StructField(relation.target_field, T.LongType())])
                links = self.spark.createDataFrame([], kind)
                if evolves:
                    owners = self.table(relation.owner)
                    held = owners.where(Navigator.has_value(known["field"])).select(F.col(self.ids[relation.owner]), F.col(known["field"]))
                    links = links.union(held)
                    self._put(relation.owner, owners.drop(known["field"]))
                self._put(relation.links, links)
            self._set("relations", name, fresh)

    @property
    def navigate(self) -> Navigator:
        return Navigator(self.relations, self.table, self.ids)

    # -- raw SQL and upkeep

    def sql(self, text: str, **args: Any) -> DataFrame:
        """Parameterised SQL (``:name``) over the collections as views."""
        for name in self.names():
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=args or None)

    def execute(self, text: str, **args: Any) -> int:
        """A raw INSERT INTO t (a, b) SELECT or VALUES, UPDATE t SET a = x WHERE c, or DELETE FROM t WHERE c, with ``:name``
        arguments, through the collection: ids, indexes, handlers and policies hold. Returns the number of rows."""
        bound = lambda x: reduce(lambda t, kv: re.sub(rf":{kv[0]}\b", lambda _: _literal(kv[1]), t), args.items(), x)
        text = bound(text.strip().rstrip(";"))
        if m := re.match(r"(?is)DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.+))?\Z", text):
            return self.collection(m[1]).delete_many(F.expr(m[2] or "true"))
        if m := re.match(r"(?is)UPDATE\s+(\w+)\s+SET\s+(.+?)(?:\s+WHERE\s+(.+))?\Z", text):
            changes = (x.split("=", 1) for x in re.split(r",(?![^()]*\))(?=\s*\w+\s*=)", m[2]))
            return self.collection(m[1]).update_many(F.expr(m[3] or "true"), {c.strip(): F.expr(v) for c, v in changes})
        if m := re.match(r"(?is)INSERT\s+INTO\s+(\w+)\s*\(([^)]*)\)\s*(SELECT.+|VALUES.+)\Z", text):
            rows = cut(self.sql(m[3]).toDF(*(c.strip() for c in m[2].split(","))))
            self.collection(m[1]).insert_batch(rows)
            return rows.count()
        raise NotSupported("only INSERT INTO, UPDATE and DELETE FROM are executed")

    def sql_map(self, text: str, *split_on: str, **args: Any) -> DataFrame:
        """A query whose columns hold several objects side by side, as one struct each (``_1``, ``_2``, ...): each name of
        ``split_on`` starts the next object at the next column of that name."""
        found = self.sql(text, **args)
        names, starts = found.columns, [0]
        for name in split_on:
            rest = [i for i in range(starts[-1] + 1, len(names)) if names[i] == name]
            if not rest:
                raise InvalidOperation(f"no further column {name} to split on")
            starts.append(rest[0])
        flat = found.toDF(*(f"c{i}" for i in range(len(names))))
        ends = [*starts[1:], len(names)]
        return flat.select(*(F.struct(*(F.col(f"c{i}").alias(names[i]) for i in range(a, b))).alias(f"_{k}") for k, (a, b) in enumerate(zip(starts, ends, strict=True), 1)))

    def sql_first(self, text: str, default: Any = ..., **args: Any) -> Any:
        row = self.sql(text, **args).first()
        if row is None:
            if default is ...:
                raise KeyNotFound("the query has no rows")
            return default
        return row

    def backup(self, target: str) -> None:
        """Copy every collection, with its indexes, relations and ids."""
        other = Database(self.spark, target)
        with self.transaction(), other.transaction():
            for name in self.names():
                other._put(name, self.table(name))
            for section in ("indexes", "relations", "ids", "attached"):
                for key, value in self._section(section).items():
                    other._set(section, key, value)

    def vacuum(self, grace_s: float = 86_400) -> int:
        """Delete versions that no reader can reach and that were left ``grace_s`` seconds ago; returns how many."""
        return self.storage.vacuum(grace_s) if self.storage else 0

    def optimize(self) -> None:
        """Rewrite collections into files of an even size."""
        for name in self.names():
            self._put(name, self.table(name).hint("rebalance"))

    def enable_caching(self) -> None:
        self.caching = True

    def disable_caching(self) -> None:
        self.caching = False
        self.clear_caching()

    def clear_caching(self) -> None:
        self.spark.catalog.clearCache()


class Collection:
    """Documents of one table. Every mutation computes the table's new rows, runs handlers and swaps them in."""

    def __init__(self, db: Database, name: str, id: str, generate: Callable | None) -> None:
        self.db, self.name, self.id, self.generate = db, name, id, generate

    @property
    def df(self) -> DataFrame:
        out = self.db.table(self.name)
        return out.cache() if self.db.caching else out

    def query(self) -> Query:
        return Query(self.df, id=self.id)

    def get(self, key: Any, field: str | None = None) -> Row:
        row = self.try_get(key, field)
        if row is None:
            raise KeyNotFound(f"{self.name} has no document {key!r}")
        return row

    def try_get(self, key: Any, field: str | None = None) -> Row | None:
        return self.df.where(F.col(field or self.id) == F.lit(key)).limit(1).first()

    # -- indexes

    def ensure_index(self, *fields: str, unique: bool = False) -> None:
        """Recorded with the database. A unique one is checked now and on every write. A field is a column or an
        SQL expression over columns; constants, sub-queries and the id are refused."""
        df = self.df
        for f in fields:
            if f in df.columns:
                continue
            try:
                plan = df.selectExpr(f)._jdf.queryExecution().analyzed()
            except AnalysisException as error:
                raise InvalidOperation(f"can't be indexed: {f}") from error
            used = plan.references().mkString(" ")
            if not used or "subquery" in plan.expressions().mkString(" ") or re.search(rf"\b{self.id}#", used):
                raise InvalidOperation(f"can't be indexed: {f}")
        if not fields or self.id in fields:
            raise InvalidOperation(f"can't be indexed: {fields}")
        if unique:
            self._check_unique(df, [fields])
        self.db._set("indexes", self.name, self._indexes() | {json.dumps(fields): unique})

    def drop_index(self, *fields: str) -> bool:
        known = self._indexes()
        if known.pop(json.dumps(fields), None) is None:
            return False
        self.db._set("indexes", self.name, known)
        return True

    def _indexes(self) -> dict[str, bool]:
        return dict(self.db._section("indexes").get(self.name, {}))

    def _unique(self) -> list[tuple[str, ...]]:
        return [tuple(json.loads(k)) for k, u in self._indexes().items() if u]

    def _keyed(self, df: DataFrame, key: tuple[str, ...]) -> DataFrame:
        """The values of a unique key, of rows that have all of them."""
        return df.selectExpr(*(f"{f} AS k{i}" for i, f in enumerate(key))).dropna()

    def duplicates(self, *fields: str) -> DataFrame:
        """Keys (columns or SQL expressions) that more than one document has, as ``k0, k1, ...``, with their ``count``."""
        return self._twice(self.df, fields)

    def _twice(self, df: DataFrame, key: tuple[str, ...]) -> DataFrame:
        values = self._keyed(df, key)
        return values.groupBy(*values.columns).count().where("count > 1")

    def _check_unique(self, df: DataFrame, keys: Iterable[tuple[str, ...]], others: DataFrame | None = None) -> None:
        """No key twice in ``df``, nor in both ``df`` and ``others``."""
        for key in keys:
            twice = self._twice(df, key).drop("count").limit(1).first()
            if twice is None and others is not None:
                values = self._keyed(df, key)
                twice = values.join(self._keyed(others, key), values.columns, "left_semi").limit(1).first()
            if twice is not None:
                raise UniqueViolation(f"{self.name}: more than one document with {dict(zip(key, twice, strict=True))}")

    # -- writes

    def _number(self, rows: list[dict]) -> None:
        """Give rows without an id the next one, in their order."""
        if not self._numbers():
            return
        top = None
        for r in rows:
            if (r.get(self.id) or 0) < 0:
                raise InvalidOperation("a negative id")
            if top is None:
                top = 0 if all(x.get(self.id) for x in rows) else self.df.agg(F.max(self.id)).first()[0] or 0
            r[self.id] = r.get(self.id) or top + 1
            top = max(top, r[self.id])

    def _rows(self, items: Iterable[dict | Row] | DataFrame, number: bool = False, *more: Column) -> DataFrame:
        schema = self.df.schema
        if isinstance(items, DataFrame):
            out = items
        else:
            rows = [dict(i.asDict() if isinstance(i, Row) else i) if i is not None else None for i in items]
            if None in rows:
                raise InvalidOperation("a document is null")
            if self.generate:
                for r in rows:
                    if r.get(self.id) in (None, 0, ""):
                        r[self.id] = self.generate(self, r)
            elif number:
                self._number(rows)
            variants = [f.name for f in schema if isinstance(f.dataType, T.VariantType)]
            flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in variants else f.dataType) for f in schema])
            out = self.db.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], flat)
            for v in variants:
                out = out.withColumn(v, F.parse_json(v))
        kinds = {f.name: _open(f.dataType) for f in schema}
        return out.select(*((F.col(n) if n in out.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()), *more)

    def _numbers(self) -> bool:
        """Whether documents without an id are numbered."""
        return self.df.schema[self.id].dataType.typeName() in ("long", "integer")

    def _zero_is_id(self) -> bool:
        """Attached rows have ids of their own, and so may have 0; where documents are numbered it stands for none, unless one has it."""
        return not self._numbers() or self.name in self.db._section("attached") or self.try_get(0) is not None

    def _no_id(self, zero: bool) -> Column:
        return F.col(self.id).isNull() if zero else F.coalesce(F.col(self.id), F.lit(0)) == 0

    def _with_ids(self, fresh: DataFrame, zero: bool = False) -> DataFrame:
        """Give rows without an id (null, or 0 unless ``zero`` is an id) the next ones; a negative id is refused."""
        if not self._numbers():
            return fresh
        none = self._no_id(zero)
        facts = fresh.agg(F.min(self.id).alias("least"), F.count_if(none).alias("open"), F.max(self.id).alias("most")).first()
        if facts.least is not None and facts.least < 0:
            raise InvalidOperation("a negative id")
        if not facts.open:
            return fresh
        top = max(self.df.agg(F.max(self.id)).first()[0] or 0, facts.most or 0)
        fresh = cut(fresh.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
        rows = fresh.where(none)
        counts = rows.groupBy("__part").count().selectExpr("__part", "sum(count) over (order by __part) - count as __before")
        numbered = rows.withColumn("__n", F.expr("row_number() over (partition by __part order by __at)")).join(F.broadcast(counts), "__part")
        named = numbered.withColumn(self.id, (F.col("__n") + F.col("__before") + top).cast(self.df.schema[self.id].dataType))
        keep = self.df.columns
        return named.select(*keep).union(fresh.where(~none).select(*keep))

    def _write(self, kind: str, rows: DataFrame, items: DataFrame | None, old: DataFrame | None, unique: bool = True) -> None:
        """Replace the table's rows. The indexed keys of ``items`` are checked against the rows that they don't replace."""
        change = Change(self.db, self.name, items, old)
        with self.db.transaction():
            self.db.handlers.fire({"insert": "inserting", "update": "updating", "delete": "deleting"}[kind], change)
            if unique and items is not None and self._unique():
                self._check_unique(items, self._unique(), rows.join(items.select(self.id), self.id, "left_anti"))
            self.db._put(self.name, rows)
            self.db.handlers.fire({"insert": "inserted", "update": "updated", "delete": "deleted"}[kind], change)

    def insert(self, item: dict | Row) -> Any:
        """Returns the id, generated if it isn't given."""
        return self.insert_batch([item])[0]

    def insert_batch(self, items: Iterable[dict | Row] | DataFrame) -> list | DataFrame:
        """All or none; only the new rows are written. Returns the ids: a list in the order of the items, or for a DataFrame
        a DataFrame (of any size)."""
        with self.db.transaction():
            fresh, ids = self._rows(items, True), None
            if isinstance(items, DataFrame):
                fresh = cut(self._with_ids(fresh))
            else:
                fresh = cut(fresh.withColumn("__at", F.monotonically_increasing_id()))
                ids = [r[0] for r in fresh.orderBy("__at").select(self.id).collect()]
                fresh = fresh.drop("__at")
            change = Change(self.db, self.name, fresh, None)
            self.db.handlers.fire("inserting", change)
            self._check_unique(fresh, [(self.id,), *self._unique()], self.df)
            self.db._append(self.name, fresh)
            self.db.handlers.fire("inserted", change)
        return fresh.select(self.id) if ids is None else ids

    def upsert(self, item: dict | Row) -> None:
        self.upsert_batch([item])

    def upsert_batch(self, items: Iterable[dict | Row] | DataFrame, last_wins: Column | None = None) -> None:
        """Insert, or replace documents of equal id or unique key. Of several items of one id the last in order of
        ``last_wins`` (else of the list) stays. Items without an id are numbered: those of null and, unless the rows
        were attached or a document has it, of 0."""
        last_wins = last_wins if isinstance(items, DataFrame) else F.monotonically_increasing_id()
        fresh = cut(self._rows(items, False, *([] if last_wins is None else [last_wins.alias("__at")])))
        zero = self._zero_is_id()
        none = self._no_id(zero)
        given = fresh.where(~none)
        if last_wins is not None:
            best = given.groupBy(self.id).agg(F.max_by(F.struct(*given.columns), "__at").alias("__row")).select("__row.*")
            given = best
        new = fresh.where(none)
        fresh = cut(self._with_ids(given.select(*self.df.columns).union(new.select(*self.df.columns)), zero))
        kept = self.df.join(fresh.select(self.id), self.id, "left_anti")
        for key in self._unique():
            mine = self._keyed(fresh, key)
            named = kept.selectExpr("*", *(f"{f} AS __k{i}" for i, f in enumerate(key)))
            met = reduce(lambda a, b: a & b, (F.col(f"__k{i}") == F.col(f"k{i}") for i in range(len(key))))
            kept = named.join(mine, met, "left_anti")
        self._write("update", kept.select(*self.df.columns).unionByName(fresh), fresh, self.df.join(fresh.select(self.id), self.id, "left_semi"))

    def update(self, item: dict | Row, version: Any = None, version_field: str | None = None) -> None:
        """Replace the whole document of the item's id. With a version, the stored one has to equal it."""
        fresh = cut(self._rows([item]))
        key = (item.asDict() if isinstance(item, Row) else item).get(self.id)
        if key in (None, ""):
            raise InvalidOperation("the document has no id")
        old = self.get(key)
        if version_field and old[version_field] != version:
            raise VersionConflict(f"{self.name} {key}: version {old[version_field]} isn't {version}")
        rest = self.df.where(F.col(self.id) != F.lit(key))
        self._write("update", rest.unionByName(fresh), fresh, self.df.where(F.col(self.id) == F.lit(key)))

    def update_many(self, condition: Column, *steps: dict[str, Column]) -> int:
        """Set columns where the condition holds; later steps see earlier ones, and all see one condition. Returns the count."""
        for s in steps:
            if self.id in s:
                raise NotSupported("ids don't change")
        old = self.df.withColumn("__hit", F.coalesce(condition, F.lit(False)))
        rows = old
        for s in steps:
            rows = rows.withColumns({c: F.when(F.col("__hit"), v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(_open(self.df.schema[c].dataType)) for c, v in s.items()})
        n = old.where("__hit").count()
        if n:
            self._write("update", rows.drop("__hit"), rows.where("__hit").drop("__hit"), old.where("__hit").drop("__hit"))
        return n

    def replace_many(self, condition: Column, item: dict) -> int:
        """Every matching document's fields become the item's; ids stay."""
        return self.update_many(condition, {f.name: F.lit(item.get(f.name)) for f in self.df.schema if f.name != self.id})

    def replace_one(self, condition: Column, item: dict) -> int:
        key = self._first_id(condition)
        return 0 if key is None else self.replace_many(F.col(self.id) == F.lit(key), item)

    def _first_id(self, condition: Column) -> Any:
        return self.df.where(condition).agg(F.min(self.id)).first()[0]

    def delete(self, key: Any, field: str | None = None) -> int:
        return self.delete_many(F.col(field or self.id) == F.lit(key))

    def delete_one(self, condition: Column) -> int:
        key = self._first_id(condition)
        return 0 if key is None else self.delete(key)

    def delete_many(self, condition: Column) -> int:
        """Returns the count. Relations' policies apply first, in one transaction."""
        hit = F.coalesce(condition, F.lit(False))
        gone = cut(self.df.where(hit).select(self.id))
        n = gone.count()
        if not n:
            return 0
        with self.db.transaction():
            doomed = _Doomed(self.db)
            doomed.close(self.name, gone)
            doomed.check(self.name, gone)
            doomed.apply()
        return n

    def write_batch(self, batch: DataFrame, number: int, upsert: bool = False) -> None:
        """A stream's batch; one that was written before is skipped."""
        with self.db.transaction():
            if self.db._section("batches").get(self.name, -1) >= number:
                return
            (self.upsert_batch if upsert else self.insert_batch)(batch)
            self.db._set("batches", self.name, number)

    # -- relations

    def _linked(self, name: str) -> ToMany:
        rel = self.db.navigate._relation(self.name, name)
        if not rel.links:
            raise NotSupported("the relation has no link table")
        return rel

    def _missing(self, rel: ToMany, source: Any, targets: Iterable[Any]) -> DataFrame:
        """The source's links to these targets that don't exist. Of the link table only the same links are compared; all
        others are left out where they are read."""
        known = self.db.table(rel.links)
        fresh = self.db.spark.createDataFrame([(source, t) for t in dict.fromkeys(targets)], known.schema)
        same = known.where(F.col(rel.source_field) == F.lit(source)).join(F.broadcast(fresh), known.columns, "left_semi")
        return fresh.join(same, known.columns, "left_anti")

    def link(self, name: str, source: Any, *targets: Any) -> None:
        """Add targets to a to-many relation; links that exist stay single."""
        rel = self._linked(name)
        self.db._append(rel.links, self._missing(rel, source, targets))

    def unlink(self, name: str, source: Any, *targets: Any) -> None:
        """Remove targets (none given: all) from a to-many relation."""
        rel = self._linked(name)
        here = F.col(rel.source_field) == F.lit(source)
        if targets:
            here = here & F.col(rel.target_field).isin(list(targets))
        self.db._put(rel.links, self.db.table(rel.links).where(~F.coalesce(here, F.lit(False))))

    def set_links(self, name: str, source: Any, targets: Iterable[Any]) -> None:
        """Make exactly these the targets. Links that go are removed in one write; if none go, only new ones are written."""
        rel, targets = self._linked(name), list(dict.fromkeys(targets))
        with self.db.transaction():
            known = self.db.table(rel.links)
            stale = (F.col(rel.source_field) == F.lit(source)) & ~F.col(rel.target_field).isin(targets)
            fresh = self._missing(rel, source, targets)
            if known.where(stale).limit(1).count():
                self.db._put(rel.links, known.where(~F.coalesce(stale, F.lit(False))).union(fresh))
            elif targets:
                self.db._append(rel.links, fresh)

    def set_reference(self, condition: Column, field: str, target: Any) -> int:
        if (self.name, field) not in self.db.relations.one:
            raise NotSupported(f"{field} isn't a reference")
        return self.update_many(condition, {field: F.lit(target)})

    def update_through(self, path: tuple[str, ...], condition: Column, change: dict[str, Column]) -> int:
        """Change documents at the end of a path of references from the matching ones."""
        nav, owner = self.db.navigate, self.name
        found = nav.reference(self.query().where(condition), owner, *path).frame
        for step in path:
            rel = self.db.relations.one[owner, step]
            owner = rel.target
        key = "_".join(path) + f"_{rel.target_key}"
        target = Collection(self.db, owner, self.db.ids[owner], None)
        ids = found.select(F.col(key).alias("__key")).dropna().distinct()
        marked = target.df.join(cut(ids).withColumn("__mark", F.lit(True)), F.col(rel.target_key) == F.col("__key"), "left").drop("__key")
        rows = marked
        for c, v in change.items():
            rows = rows.withColumn(c, F.when(F.col("__mark"), v).otherwise(F.col(c)))
        n = marked.where("__mark").count()
        if n:
            target._write("update", rows.drop("__mark"), rows.where("__mark").drop("__mark"), marked.where("__mark").drop("__mark"))
        return n

    def link_through(self, path: tuple[str, ...], condition: Column, name: str, *targets: Any, remove: bool = False) -> None:
        """Add targets to (or remove them from; none given: clear) a to-many relation of the documents at the end of a path of references."""
        owner = self.name
        found = self.db.navigate.reference(self.query().where(condition), owner, *path).frame
        for step in path:
            rel = self.db.relations.one[owner, step]
            owner = rel.target
        many = self.db.navigate._relation(owner, name)
        links = self.db.table(many.links)
        ids = found.select(F.col("_".join(path) + f"_{rel.target_key}").alias(many.source_field)).dropna().distinct()
        if targets:
            ids = ids.withColumn(many.target_field, F.explode(F.array(*map(F.lit, targets)).cast("array<long>")))
        on = [many.source_field, many.target_field] if targets else [many.source_field]
        fresh = links.join(ids, on, "left_anti") if remove or not targets else links.unionByName(ids).distinct()
        self.db._put(many.links, fresh.select(*links.columns))

    def insert_graph(self, item: dict) -> Any:
        """Insert a document with new documents in place of its references (dicts) and to-many targets (lists of dicts), those
        first. A dict that occurs more than once is one document, also where documents refer to each other in a circle."""
        keys: dict[int, Any] = {}
        later: list[Callable[[], Any]] = []
        with self.db.transaction():
            key = self._insert_graph(item, keys, later)
            for step in later:
                step()
        return key

    def _insert_graph(self, item: dict, keys: dict[int, Any], later: list[Callable[[], Any]]) -> Any:
        if id(item) in keys:
            return keys[id(item)]  # None while it is being inserted
        keys[id(item)] = None
        flat, open_ones, many = dict(item), {}, {}
        for rel in self.db.relations.outbound(self.name):
            name = rel.key[1]
            value = flat.get(name)
            other = Collection(self.db, rel.target, self.db.ids[rel.target], None)
            if isinstance(rel, ToOne) and isinstance(value, dict):
                flat[name] = other._insert_graph(value, keys, later)
                if flat[name] is None:
                    open_ones[name] = value
            elif isinstance(rel, ToMany) and value:
                many[name] = [(v, other._insert_graph(v, keys, later) if isinstance(v, dict) else v) for v in flat.pop(name)]
        key = keys[id(item)] = self.insert(flat)
        for name, value in open_ones.items():
            later.append(lambda name=name, value=value: self.update_many(F.col(self.id) == F.lit(key), {name: F.lit(keys[id(value)])}))
        for name, targets in many.items():
            done = [t for _, t in targets if t is not None]
            if done:
                self.link(name, key, *done)
            for v in (v for v, t in targets if t is None):
                later.append(lambda name=name, v=v: self.link(name, key, keys[id(v)]))
        return key


def _open(kind: T.DataType) -> T.DataType:
    """The type with everything in it nullable, to which all rows of the type can be cast."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_open(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _open(kind.valueType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _open(f.dataType)) for f in kind])
    return kind


def _literal(value: Any) -> str:
    if value is None or isinstance(value, (bool, int, float)):
        return {None: "NULL", True: "true", False: "false"}[value] if value is None or isinstance(value, bool) else repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Doomed:
    """The ids that a deletion takes with it, by collection, as tables."""

    def __init__(self, db: Database) -> None:
        self.db, self.ids, self.catalog = db, {}, db.relations

    def add(self, name: str, ids: DataFrame) -> DataFrame | None:
        """The ids that weren't there yet, or None if all were."""
        fresh = ids.toDF("id").dropna().distinct()
        if name in self.ids:
            fresh = fresh.join(self.ids[name], "id", "left_anti")
        fresh = cut(fresh)
        if not fresh.limit(1).count():
            return None
        self.ids[name] = fresh if name not in self.ids else cut(self.ids[name].union(fresh))
        return fresh

    def pairs(self, rel: ToOne | ToMany) -> DataFrame | None:
        """A relation's links as (source, target); None if it has no rows of its own."""
        if not self.db.exists(rel.owner):
            return None
        if isinstance(rel, ToOne):
            return self.db.table(rel.owner).where(Navigator.has_value(rel.field)).select(F.col(self.db.ids[rel.owner]).alias("source"), F.col(rel.field).alias("target"))
        return self.db.table(rel.links).toDF("source", "target") if rel.links else None

    def sources(self, rel: ToOne | ToMany, targets: DataFrame) -> DataFrame | None:
        pairs = self.pairs(rel)
        return None if pairs is None else pairs.join(targets.toDF("target"), "target", "left_semi").select("source")

    def left(self, rel: ToOne | ToMany, pairs: DataFrame) -> DataFrame:
        """Links whose owner stays."""
        return pairs.join(self.ids[rel.owner].toDF("source"), "source", "left_anti") if rel.owner in self.ids else pairs

    def close(self, name: str, ids: DataFrame) -> None:
        """Add ``ids`` and all that follows from them: owners that cascade, until there are no more; then targets that
        their owners' deletion takes along and that nothing that stays refers to; and so on until nothing is added."""
        todo = [(name, ids)]
        while todo:
            while todo:
                at, found = todo.pop()
                fresh = self.add(at, found)
                for rel in self.catalog.inbound(at) if fresh is not None else []:
                    if rel.on_delete == "cascade" and (owners := self.sources(rel, fresh)) is not None:
                        todo.append((rel.owner, owners))
            for at in list(self.ids):
                for rel in self.catalog.outbound(at):
                    pairs = self.pairs(rel) if rel.on_owner_delete in ("cascade", "deletion") else None
                    if pairs is None:
                        continue
                    targets = pairs.join(self.ids[at].toDF("source"), "source", "left_semi").select("target").distinct()
                    if rel.target in self.ids:
                        targets = targets.join(self.ids[rel.target].toDF("target"), "target", "left_anti")
                    if rel.on_owner_delete == "deletion":
                        for other in self.catalog.inbound(rel.target):
                            if (held := self.pairs(other)) is not None:
                                targets = targets.join(self.left(other, held).select("target").distinct(), "target", "left_anti")
                    targets = cut(targets)
                    if targets.limit(1).count():
                        todo.append((rel.target, targets))

    def check(self, root: str, ids: DataFrame) -> None:
        """Raise if an owner that stays restricts the deletion of a target, or the deleted documents themselves that of
        owners with targets."""
        for name, gone in self.ids.items():
            for rel in self.catalog.inbound(name):
                pairs = self.pairs(rel) if rel.on_delete == "restrict" else None
                if pairs is not None and self.left(rel, pairs).join(gone.toDF("target"), "target", "left_semi").limit(1).count():
                    raise PolicyViolation(f"{'.'.join(rel.key)} still refers to documents of {name}")
        for rel in self.catalog.outbound(root):
            pairs = self.pairs(rel) if rel.on_owner_delete == "restrict" else None
            if pairs is not None and pairs.join(ids.toDF("source"), "source", "left_semi").limit(1).count():
                raise PolicyViolation(f"documents of {root} still have targets in {rel.target}")

    def apply(self) -> None:
        """Clear what refers to the doomed documents, and delete them."""
        for name, gone in self.ids.items():
            for rel in self.catalog.inbound(name):
                if isinstance(rel, ToOne) and self.db.exists(rel.owner):
                    owner = Collection(self.db, rel.owner, self.db.ids[rel.owner], None)
                    owners = owner.df
                    mine = gone.toDF("__gone")
                    hit = owners.join(mine, F.col(rel.field) == F.col("__gone"), "left_semi")
                    if rel.owner in self.ids:
                        hit = hit.join(self.ids[rel.owner].toDF(owner.id), owner.id, "left_anti").select(*owners.columns)
                    if hit.limit(1).count():
                        marked = owners.join(mine, F.col(rel.field) == F.col("__gone"), "left")
                        fresh = marked.withColumn(rel.field, F.when(F.col("__gone").isNull(), F.col(rel.field))).select(*owners.columns)
                        owner._write("update", fresh, hit.withColumn(rel.field, F.lit(None).cast(owners.schema[rel.field].dataType)), hit, unique=False)
        for rel in self.catalog.many.values():
            ends = [(e, n) for e, n in (("source", rel.owner), ("target", rel.target)) if n in self.ids]
            if rel.links and ends and self.db.exists(rel.links):
                links = self.db.table(rel.links)
                rest = links.toDF("source", "target")
                for end, n in ends:
                    rest = rest.join(self.ids[n].toDF(end), end, "left_anti")
                self.db._put(rel.links, rest.select("source", "target").toDF(*links.columns))
        for name, gone in self.ids.items():
            col = Collection(self.db, name, self.db.ids[name], None)
            rows, mine = col.df, gone.toDF(col.id)
            col._write("delete", rows.join(mine, col.id, "left_anti").select(*rows.columns), None, rows.join(mine, col.id, "left_semi").select(*rows.columns), unique=False)
