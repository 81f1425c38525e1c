"""Relations between collections: to-one by a foreign key, to-many by a link table, and queries over both."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.errors import InvalidOperation, NotSupported
from docframe.operators import ordering, sets
from docframe.plans.grouping import GroupChain
from docframe.plans.query import Query, column

POLICIES = ("restrict", "cascade", "unlink", "deletion")
DEPTH = 10


@dataclass(frozen=True)
class ToOne:
    """``owner.field`` holds the id of a target document; null or 0 is none."""

    owner: str
    field: str
    target: str
    target_key: str
    on_delete: str = "restrict"
    on_owner_delete: str = "unlink"

    @property
    def key(self) -> tuple[str, str]:
        return self.owner, self.field


@dataclass(frozen=True)
class ToMany:
    """Links (source, target) between an owner and targets. ``links`` names a link table; where it is empty, the target itself
    holds the owner's id in ``target_field``."""

    owner: str
    name: str
    target: str
    target_key: str
    links: str = ""
    source_field: str = "SourceId"
    target_field: str = "TargetId"
    on_delete: str = "unlink"
    on_owner_delete: str = "unlink"

    @property
    def key(self) -> tuple[str, str]:
        return self.owner, self.name


@dataclass
class RelationCatalog:
    """Relations by owner and name, checked when they are added."""

    one: dict[tuple[str, str], ToOne] = field(default_factory=dict)
    many: dict[tuple[str, str], ToMany] = field(default_factory=dict)

    def add(self, relation: ToOne | ToMany) -> RelationCatalog:
        for policy in (relation.on_delete, relation.on_owner_delete):
            if policy not in POLICIES:
                raise InvalidOperation(f"no delete policy {policy!r}")
        if relation.on_delete == "deletion":
            raise InvalidOperation("deletion is a policy for the owner's side only")
        if relation.on_owner_delete == "cascade" and isinstance(relation, ToOne) and relation.owner == relation.target:
            raise InvalidOperation("a collection can't cascade to itself")
        key = relation.key
        if key in self.one or key in self.many:
            known = self.one.get(key) or self.many.get(key)
            if known != relation:
                raise InvalidOperation(f"conflicting definitions of {key[0]}.{key[1]}")
        (self.one if isinstance(relation, ToOne) else self.many)[key] = relation
        return self

    def inbound(self, target: str) -> list[ToOne | ToMany]:
        return [r for r in [*self.one.values(), *self.many.values()] if r.target == target]

    def outbound(self, owner: str) -> list[ToOne | ToMany]:
        return [r for r in [*self.one.values(), *self.many.values()] if r.owner == owner]


class Navigator:
    """Queries along relations. ``tables`` gives a collection's DataFrame by name."""

    def __init__(self, catalog: RelationCatalog, tables, ids: dict[str, str]) -> None:
        self.catalog, self.tables, self.ids = catalog, tables, ids

    def query(self, name: str) -> Query:
        return Query(self.tables(name), id=self.ids.get(name))

    def reference(self, query: Query, owner: str, *path: str, prefix: str = "") -> Query:
        """Left-join the targets along a path of to-one fields; their columns get ``<field>_`` in front, once for each hop."""
        if len(path) > DEPTH:
            raise NotSupported(f"more than {DEPTH} hops")
        frame, at = query.frame, prefix
        for step in path:
            rel = self.catalog.one.get((owner, step))
            if rel is None:
                raise NotSupported(f"{owner}.{step} isn't a reference")
            target = self.tables(rel.target)
            renamed = target.select(*(F.col(c).alias(f"{at}{step}_{c}") for c in target.columns))
            if f"{at}{step}_{rel.target_key}" not in frame.columns:  # joined once, however often it is used
                frame = frame.join(renamed, F.col(f"{at}{step}") == F.col(f"{at}{step}_{rel.target_key}"), "left")
            at, owner = f"{at}{step}_", rel.target
        return query._with(frame)

    @staticmethod
    def has_value(ref: Column | str) -> Column:
        return F.coalesce(column(ref) != 0, F.lit(False))

    def _links(self, rel: ToMany) -> DataFrame:
        if rel.links:
            return self.tables(rel.links).select(F.col(rel.source_field).alias("__source"), F.col(rel.target_field).alias("__target"))
        return self.tables(rel.target).select(F.col(rel.target_field).alias("__source"), F.col(rel.target_key).alias("__target"))

    def _targets(self, rel: ToMany) -> DataFrame:
        """Targets with the owner's id as ``__source``."""
        target = self.tables(rel.target)
        if not rel.links:
            return target.withColumn("__source", F.col(rel.target_field))
        return self._links(rel).join(target, F.col("__target") == F.col(rel.target_key)).drop("__target")

    def _relation(self, owner: str, name: str) -> ToMany:
        if (owner, name) not in self.catalog.many:
            raise NotSupported(f"{owner}.{name} isn't a to-many relation")
        return self.catalog.many[owner, name]

    def many(self, query: Query, owner: str, name: str) -> ManyChain:
        """A chain over each owner's targets. Terminals give the owners' ids with one value."""
        rel = self._relation(owner, name)
        if query.id is None:
            raise InvalidOperation("the owner needs an id")
        owners = query.frame.select(query.id)
        targets = self._targets(rel).withColumnRenamed("__source", f"__g_{query.id}")
        targets = targets.join(owners.select(F.col(query.id).alias("__owner")), F.col(f"__g_{query.id}") == F.col("__owner"), "left_semi")
        return ManyChain(targets, (query.id,), owners, self.ids.get(rel.target))

    def where_any(self, query: Query, owner: str, name: str, p: Column | None = None) -> Query:
        """Owners with a target (for which ``p`` holds): a semi join."""
        targets = self._targets(self._relation(owner, name))
        targets = targets if p is None else targets.where(p)
        return query._with(sets.intersect_in(query.frame, F.col(query.id), targets, F.col("__source")))

    def where_all(self, query: Query, owner: str, name: str, p: Column) -> Query:
        """Owners without a target for which ``p`` is false; a null ``p`` is no violation."""
        bad = self._targets(self._relation(owner, name)).where(~p).where("__source is not null")
        return query._with(sets.except_safe(query.frame, F.col(query.id), bad, F.col("__source")))

    def where_contains(self, query: Query, owner: str, name: str, target_id) -> Query:
        rel = self._relation(owner, name)
        links = self._links(rel).where(F.col("__target") == F.lit(target_id))
        return query._with(sets.intersect_in(query.frame, F.col(query.id), links, F.col("__source")))

    def flatten(self, query: Query, owner: str, *path: str) -> Query:
        """Owner rows with each of their targets' columns, along one or two to-many relations; owners without
        any are left out. Of clashing names, targets' get ``<relation>_`` in front."""
        if len(path) > DEPTH:
            raise NotSupported(f"more than {DEPTH} hops")
        frame, key = query.frame, query.id
        for step in path:
            rel = self._relation(owner, step)
            targets = self._targets(rel)
            fresh = targets.select(*(F.col(c).alias(c if c == "__source" or c not in frame.columns else f"{step}_{c}") for c in targets.columns))
            frame = frame.join(fresh, F.col(key) == F.col("__source")).drop("__source")
            key = rel.target_key if f"{step}_{rel.target_key}" not in frame.columns else f"{step}_{rel.target_key}"
            owner = rel.target
        return query._with(frame)

    def include(self, query: Query, owner: str, *names: str, exclude: tuple[str, ...] = ()) -> Query:
        """The owners with whole targets: a struct for each reference (``<field>_value``), a list by target id for each to-many relation.
        ``a.b`` includes relation b of the targets of a. Without names, all relations of the owner that aren't excluded.
        A list holds all targets of one owner, however many; page through a chain (``many``) where that is too much."""
        if not names:
            names = tuple(r.key[1] for r in self.catalog.outbound(owner) if r.key[1] not in exclude)
        clash = {(n, e) for n in names for e in exclude if n == e or n.startswith(f"{e}.")}
        if clash:
            raise NotSupported(f"included under what is excluded: {clash}")
        frame = query.frame
        for name in dict.fromkeys(n.split(".")[0] for n in names):
            inner = [n[len(name) + 1 :] for n in names if n.startswith(f"{name}.")]
            if (owner, name) in self.catalog.one:
                rel = self.catalog.one[owner, name]
                target = self.include(Query(self.tables(rel.target), id=rel.target_key), rel.target, *inner).frame
                whole = target.select(F.col(rel.target_key).alias("__key"), F.struct(*target.columns).alias(f"{name}_value"))
                frame = frame.join(whole, F.col(name) == F.col("__key"), "left").drop("__key")
            else:
                rel = self._relation(owner, name)
                targets = self._targets(rel)
                if inner:
                    full = self.include(Query(self.tables(rel.target), id=rel.target_key), rel.target, *inner).frame
                    targets = targets.select("__source", rel.target_key).join(full, rel.target_key)
                row = F.struct(F.col(rel.target_key), *(F.col(c) for c in targets.columns if c not in ("__source", rel.target_key)))
                lists = targets.groupBy("__source").agg(F.array_sort(F.collect_list(row)).alias(name))
                frame = frame.join(lists, F.col(query.id) == F.col("__source"), "left").drop("__source")
                frame = frame.withColumn(name, F.coalesce(name, F.array().cast(frame.schema[name].dataType)))
        return query._with(frame)


class ManyChain(GroupChain):
    """A chain over to-many targets: the group chain's operators, and the set and key operators of relations."""

    def of_type(self, name: str, kind: str = "_type") -> ManyChain:
        if kind not in self.frame.columns:
            raise NotSupported("the targets carry no type")
        return self.where(F.col(kind) == name)

    def cast(self, name: str, kind: str = "_type") -> ManyChain:
        """All targets as one type; the result fails with CastError's text where one has another."""
        return replace(self, frame=Query(self.frame, kind=kind).cast(name).frame)

    def all(self, p: Column, name: str = "all", nulls_pass: bool = True) -> DataFrame:
        return super().all(p, name, nulls_pass)

    def contains_entity(self, target_id, name: str = "contains") -> DataFrame:
        return self.any(name, F.col(self.id) == F.lit(target_id))

    def default_if_empty(self, value, name: str = "items") -> DataFrame:
        """Lists of the projected values, of one ``value`` for owners without any."""
        out = self.to_array(name)
        return out.withColumn(name, F.when(F.size(name) == 0, F.array(F.lit(value))).otherwise(F.col(name)))

    def min_by(self, key: Column | str, name: str = "first", x: Column | None = None, descending: bool = False) -> DataFrame:
        return self.order_by(key, descending=descending).element(name, 0, False, x)

    def max_by(self, key: Column | str, name: str = "first", x: Column | None = None) -> DataFrame:
        return self.min_by(key, name, x, True)

    def distinct_by(self, key: Column | str) -> ManyChain:
        return replace(self, frame=ordering.first_by(self.frame.withColumn("__k", column(key)), [*self._owner(), F.col("__k")], [(F.col(self.id), False)]))

    def count_by(self, key: Column | str, name: str = "counts") -> DataFrame:
        """A list of (Key, Value) for each owner, by key."""
        n = self.frame.groupBy(*self._owner(), column(key).alias("Key")).agg(F.count("*").alias("Value"))
        lists = n.groupBy(*(f"__g_{k}" for k in self.names)).agg(F.array_sort(F.collect_list(F.struct("Key", "Value"))).alias(name))
        return self._join(lists)

    def group_by(self, key: Column | str, having: Column | None = None, name: str = "groups", **aggregates: Column) -> DataFrame:
        """A list of (Key, aggregates) for each owner, of the groups for which ``having`` holds, by key."""
        out = self.frame.groupBy(*self._owner(), column(key).alias("Key")).agg(*(c.alias(n) for n, c in (aggregates or {"Count": F.count("*")}).items()), *([] if having is None else [having.alias("__h")]))
        out = out if having is None else out.where("__h")
        lists = out.groupBy(*(f"__g_{k}" for k in self.names)).agg(F.array_sort(F.collect_list(F.struct("Key", *(aggregates or {"Count": 0})))).alias(name))
        return self._join(lists).withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))

    def _values(self, values: list) -> Column:
        return F.array(*map(F.lit, values))

    def intersect(self, values: list) -> ManyChain:
        """Keep projected values among constants, null matching null."""
        v = self._v(None)
        return self.where(F.exists(self._values(values), lambda x: x.eqNullSafe(v))) if values else self.where(F.lit(False))

    def except_(self, values: list) -> ManyChain:
        v = self._v(None)
        return self.where(~F.exists(self._values(values), lambda x: x.eqNullSafe(v))) if values else self

    intersect_by, except_by = intersect, except_

    def union(self, values: list, name: str = "items") -> DataFrame:
        """Distinct values of the targets and the constants, as a list."""
        out = self.to_array(name)
        return out.withColumn(name, F.array_union(name, self._values(values).cast(out.schema[name].dataType)))

    union_by = union

    def concat(self, values: list, name: str = "items") -> DataFrame:
        out = self.to_array(name)
        return out.withColumn(name, F.concat(name, self._values(values).cast(out.schema[name].dataType)))

    # Set operations with another chain of the same owners, on projected values, null matching null.

    def _against(self, other: ManyChain, how: str) -> ManyChain:
        right = other.frame.select(*(F.col(f"__g_{n}").alias(f"__o_{n}") for n in self.names), other._v(None).alias("__r")).distinct()
        on = [F.col(f"__g_{n}") == F.col(f"__o_{n}") for n in self.names] + [F.col("__v").eqNullSafe(F.col("__r"))]
        frame = self.frame.withColumn("__v", self._v(None)).join(right, on, how)
        return replace(self, frame=frame, value=F.col("__v"))

    def intersect_with(self, other: ManyChain) -> ManyChain:
        return self._against(other, "left_semi")

    def except_with(self, other: ManyChain) -> ManyChain:
        return self._against(other, "left_anti")

    def concat_with(self, other: ManyChain) -> ManyChain:
        """Values of both chains; only aggregating terminals follow, as their rows have no common id."""
        values = lambda x: x.frame.select(*x._owner(), x._v(None).alias("__v"))
        return replace(self, frame=values(self).unionByName(values(other)), value=F.col("__v"), id=None, keys=())

    def union_with(self, other: ManyChain) -> ManyChain:
        both = self.concat_with(other)
        return replace(both, frame=both.frame.distinct())

    def reverse(self, *_):
        raise NotSupported("Reverse, Zip, Prepend, Append, SequenceEqual and Aggregate over a relation")

    zip = prepend = append = sequence_equal = aggregate_fold = reverse
