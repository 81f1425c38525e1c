"""Handlers around changes, and Structured Streaming into collections.

Handlers run on the driver as part of a write: those of ``inserting``, ``updating`` and ``deleting`` before anything is staged,
those of ``inserted``, ``updated`` and ``deleted`` before the commit. A handler gets the affected rows as DataFrames; if it
raises, the write is rolled back and later handlers don't run. A handler that returns "remove" is called once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from docframe.errors import Aborted, InvalidOperation

KINDS = ("inserting", "inserted", "updating", "updated", "deleting", "deleted")


@dataclass
class Change:
    """What a handler sees: the collection's database, and the rows after (``items``) and before (``old_items``)."""

    database: object
    collection: str
    items: DataFrame | None = None
    old_items: DataFrame | None = None


class Handlers:
    def __init__(self) -> None:
        self._by: dict[tuple[str, str], list[Callable]] = defaultdict(list)

    def on(self, collection: str, kind: str, handler: Callable) -> None:
        if kind not in KINDS:
            raise InvalidOperation(f"no event {kind!r}")
        self._by[collection, kind].append(handler)

    def unregister(self, collection: str, kind: str, handler: Callable) -> bool:
        found = handler in self._by[collection, kind]
        if found:
            self._by[collection, kind].remove(handler)
        return found

    def fire(self, kind: str, change: Change) -> None:
        for handler in list(self._by[change.collection, kind]):
            try:
                answer = handler(change)
            except Exception as error:
                raise Aborted(f"a handler of {kind} refused: {error}") from error
            if answer == "remove":
                self._by[change.collection, kind].remove(handler)


def stream_into(stream: DataFrame, collection, checkpoint: str, upsert: bool = False):
    """Write a streaming DataFrame into a collection, a batch at a time; handlers see every batch. The batch's number is
    kept with the collection, so a batch that is delivered again is skipped."""

    def write(batch: DataFrame, number: int) -> None:
        collection.write_batch(batch, number, upsert)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_to_stream(stream: DataFrame, f) -> DataFrame:
    """A query's stateless operators (where, select, of_type, un-nesting) over a stream."""
    from docframe.plans.query import Query

    return f(Query(stream)).df
