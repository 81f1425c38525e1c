"""A file store in two tables: entries (files and directories with metadata) and chunks of 16 KiB, compressed by Parquet."""

from __future__ import annotations

import posixpath
import time
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from docframe.errors import InvalidOperation, KeyNotFound
from docframe.sources.database import Database

CHUNK = 16 * 1024
ENTRIES = "path string, parent string, name string, directory boolean, size long, created long, modified long, metadata map<string,string>"
CHUNKS = "path string, chunk_no long, data binary"
SORTS = {"name": "name", "size": "size", "created": "created", "modified": "modified"}


def normal(path: str) -> str:
    out = posixpath.normpath("/" + path.replace("\\", "/"))
    return "/" + out.lstrip("/")


class FileStore:
    def __init__(self, db: Database, prefix: str = "files") -> None:
        self.db, self._e, self._c = db, f"{prefix}_entries", f"{prefix}_chunks"
        for name, kind in ((self._e, ENTRIES), (self._c, CHUNKS)):
            if not db.exists(name):
                db._put(name, db.spark.createDataFrame([], kind))

    @property
    def entries(self) -> DataFrame:
        return self.db.table(self._e)

    @property
    def chunks(self) -> DataFrame:
        return self.db.table(self._c)

    def _save(self, entries: DataFrame | None = None, chunks: DataFrame | None = None) -> None:
        with self.db.transaction():
            if chunks is not None:
                self.db._put(self._c, chunks)
            if entries is not None:
                self.db._put(self._e, entries)

    def _rows(self, rows: list, kind: str) -> DataFrame:
        return self.db.spark.createDataFrame(rows, kind)

    @staticmethod
    def _entry(path: str, directory: bool, size: int, now: int, metadata: dict | None = None) -> tuple:
        return (path, None if path == "/" else posixpath.dirname(path), posixpath.basename(path), directory, size, now, now, metadata or {})

    # -- content

    def upload(self, path: str, data: bytes, metadata: dict[str, str] | None = None) -> None:
        self.upload_bulk([(path, data)], metadata)

    def upload_bulk(self, files: Iterable[tuple[str, bytes]], metadata: dict[str, str] | None = None) -> None:
        """Write files whole, replacing those that exist, with the directories above them."""
        now, entries, chunks, parents = int(time.time() * 1000), [], [], set()
        for path, data in files:
            path = normal(path)
            entries.append(self._entry(path, False, len(data), now, metadata))
            chunks += [(path, i, bytes(data[at : at + CHUNK])) for i, at in enumerate(range(0, len(data), CHUNK))]
            above = posixpath.dirname(path)
            while above not in parents:
                parents.add(above)
                above = posixpath.dirname(above)
        fresh = self._rows(entries, ENTRIES)
        missing = self._rows([self._entry(p, True, 0, now) for p in parents], ENTRIES).join(self.entries, "path", "left_anti").select(*self.entries.columns)
        names = fresh.select("path")
        self._save(
            self.entries.join(names, "path", "left_anti").select(*self.entries.columns).union(fresh).union(missing),
            self.chunks.join(names, "path", "left_anti").select(*self.chunks.columns).union(self._rows(chunks, CHUNKS)),
        )

    def download(self, path: str) -> bytes:
        return self.read_at(path, 0, self.get(path).size)

    def read_at(self, path: str, offset: int, count: int) -> bytes:
        """Bytes from ``offset``; what was never written reads as zeros. Only the chunks that hold them are read."""
        path = normal(path)
        count = max(0, min(count, self.get(path).size - offset))
        first, last = offset // CHUNK, (offset + count - 1) // CHUNK
        rows = self.chunks.where((F.col("path") == path) & F.col("chunk_no").between(first, last)).collect() if count else []
        out = bytearray((last - first + 1) * CHUNK if count else 0)
        for r in rows:
            at = (r.chunk_no - first) * CHUNK
            out[at : at + len(r.data)] = r.data
        return bytes(out[offset - first * CHUNK : offset - first * CHUNK + count])

    def write_at(self, path: str, offset: int, data: bytes) -> None:
        """Overwrite from ``offset``, growing the file; a gap before it stays without chunks."""
        path = normal(path)
        if not self.exists(path):
            self.upload(path, b"")
        size, now = self.get(path).size, int(time.time() * 1000)
        first, last = offset // CHUNK, max(offset // CHUNK, (offset + len(data) - 1) // CHUNK)
        end = min(max(size, offset + len(data)), (last + 1) * CHUNK)
        old = bytearray(self.read_at(path, first * CHUNK, (last - first + 1) * CHUNK).ljust(end - first * CHUNK, b"\0"))
        old[offset - first * CHUNK : offset - first * CHUNK + len(data)] = data
        fresh = [(path, first + i, bytes(old[at : at + CHUNK])) for i, at in enumerate(range(0, len(old), CHUNK))]
        kept = self.chunks.where(~((F.col("path") == path) & F.col("chunk_no").between(first, last)))
        mine = F.col("path") == path
        entries = self.entries.withColumn("size", F.when(mine, F.greatest("size", F.lit(offset + len(data)))).otherwise(F.col("size")))
        self._save(entries.withColumn("modified", F.when(mine, F.lit(now)).otherwise(F.col("modified"))), kept.union(self._rows(fresh, CHUNKS)))

    def contents(self) -> DataFrame:
        """``path, content`` of all files, assembled on the executors."""
        parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "data"))), lambda x: F.hex(x["data"]))
        return self.chunks.groupBy("path").agg(F.unhex(F.array_join(parts, "")).alias("content"))

    # -- entries

    def try_get(self, path: str) -> Row | None:
        return self.entries.where(F.col("path") == normal(path)).limit(1).first()

    def get(self, path: str) -> Row:
        row = self.try_get(path)
        if row is None:
            raise KeyNotFound(f"no entry {path!r}")
        return row

    def exists(self, path: str) -> bool:
        return self.try_get(path) is not None

    def get_or_create(self, path: str) -> Row:
        if not self.exists(path):
            self.upload(path, b"")
        return self.get(path)

    def create_directory(self, path: str) -> Row:
        path = normal(path)
        if not self.exists(path):
            self.upload(f"{path}/.keep", b"")
            self.delete(f"{path}/.keep")
        return self.get(path)

    def _change(self, path: str, **values: Any) -> None:
        path = normal(path)
        self.get(path)
        out = self.entries
        for c, v in values.items():
            out = out.withColumn(c, F.when(F.col("path") == path, v).otherwise(F.col(c)))
        self._save(out)

    def set_modified(self, path: str, at: int) -> None:
        self._change(path, modified=F.lit(at))

    def set_created(self, path: str, at: int) -> None:
        self._change(path, created=F.lit(at))

    def set_metadata(self, path: str, key: str, value: str) -> None:
        rest = F.map_filter("metadata", lambda k, _: k != key)
        self._change(path, metadata=F.map_concat(rest, F.create_map(F.lit(key), F.lit(value))))

    def delete_metadata(self, path: str, key: str) -> None:
        self._change(path, metadata=F.map_filter("metadata", lambda k, _: k != key))

    def _under(self, path: str):
        path = normal(path)
        return (F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/")

    def delete(self, path: str) -> bool:
        """A file, or a directory with all below it."""
        if not self.exists(path):
            return False
        self._save(self.entries.where(~self._under(path)), self.chunks.where(~self._under(path)))
        return True

    def list(self, path: str = "/", directories: bool | None = None, sort: str = "name", descending: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Entries of a directory, a page of them in order."""
        out = self.entries.where(F.col("parent") == normal(path))
        if directories is not None:
            out = out.where(F.col("directory") == directories)
        key = F.col(SORTS[sort])
        out = out.orderBy(key.desc() if descending else key, "path").offset(offset) if offset else out.orderBy(key.desc() if descending else key, "path")
        return out if limit is None else out.limit(limit)

    def count(self, path: str = "/", directories: bool | None = None) -> int:
        out = self.entries.where(F.col("parent") == normal(path))
        return (out if directories is None else out.where(F.col("directory") == directories)).count()

    def walk(self, path: str = "/") -> DataFrame:
        return self.entries.where(self._under(path)).orderBy("path")

    # -- moves

    def _moved(self, df: DataFrame, source: str, target: str) -> DataFrame:
        fresh = F.concat(F.lit(target), F.substring("path", len(source) + 1, 1 << 30))
        out = df.where(self._under(source)).withColumn("path", fresh)
        if "parent" in df.columns:
            out = out.withColumn("parent", F.regexp_replace("path", "/[^/]*$", "")).withColumn("parent", F.when(F.col("parent") == "", "/").otherwise(F.col("parent")))
            out = out.withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
        return out

    def _transfer(self, source: str, target: str, replace: bool, keep: bool) -> None:
        source, target = normal(source), normal(target)
        self.get(source)
        if target == source or target.startswith(source + "/"):
            raise InvalidOperation("a directory can't go into itself")
        if self.exists(target):
            if not replace:
                raise InvalidOperation(f"{target} exists")
            self.delete(target)
        self.create_directory(posixpath.dirname(target))
        entries, chunks = self.entries, self.chunks
        left_e, left_c = (entries, chunks) if keep else (entries.where(~self._under(source)), chunks.where(~self._under(source)))
        self._save(left_e.union(self._moved(entries, source, target)), left_c.union(self._moved(chunks, source, target)))

    def move(self, source: str, target: str, replace: bool = False) -> None:
        self._transfer(source, target, replace, False)

    def copy(self, source: str, target: str, replace: bool = False) -> None:
        self._transfer(source, target, replace, True)
