"""Trace documents within tar archives, and tables of SQLite files, as data sources.

An archive is walked by its headers: where it isn't packed, members are skipped by seeking. The chosen member is streamed, some
megabytes at a time, so neither it nor the archive is ever held whole. A table of SQLite files is read by ranges of row ids, a task
each; which values of text columns are wanted is said in SQL there.
"""

from __future__ import annotations

import datetime as dt
import json
import sqlite3
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, StringType, StructType, TimestampType

from .files import opened
from .split_json import CHUNK, State, elements

ARCHIVES, SQLITE = "trace_archives", "sqlite_table"
ROWS = 100_000


def local_path(uri: str) -> str | None:
    """The path of a local file, given by path or URI; None for other stores."""
    if "://" not in uri and not uri.startswith("file:"):
        return uri
    parts = urlsplit(uri)
    return unquote(parts.path) if parts.scheme == "file" else None


def input_file(uri: str):
    path = local_path(uri)
    fs, at = (pafs.LocalFileSystem(), path) if path else opened(uri)
    return fs.open_input_file(at)


def largest_json(archive: tarfile.TarFile) -> tarfile.TarInfo | None:
    """The largest member that ends in .json, by its header."""
    members = (m for m in archive if m.isfile() and m.name.endswith(".json"))
    return max(members, key=lambda m: m.size, default=None)


def braced(stream, size: int = CHUNK) -> Iterator[bytes]:
    """A stream in pieces that end with a brace, but for the last."""
    held = b""
    while block := stream.read(size):
        cut = block.rfind(b"}") + 1
        if cut:
            yield held + block[:cut]
            held = block[cut:]
        else:
            held += block
    if held:
        yield held


@dataclass
class Archive(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in self.paths]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        packed = not partition.path.endswith(".tar")
        last = self.arrays(partition.path, packed)
        if not last:
            yield batch_of([(partition.path, -1, None)])
            return
        held, size = [], 0
        for item in self.walk(partition.path, packed):
            if not isinstance(item, State) and item[0] == last and (item[1] or item[2].strip()):
                held.append((partition.path, item[1], item[2]))
                size += len(item[2])
            if held and (size >= CHUNK or isinstance(item, State)):
                yield batch_of(held)
                held, size = [], 0

    def walk(self, path: str, packed: bool) -> Iterator:
        with input_file(path) as file, tarfile.open(fileobj=file, mode="r:*" if packed else "r:") as archive:
            if member := largest_json(archive):
                yield from elements(braced(archive.extractfile(member)), State())

    def arrays(self, path: str, packed: bool) -> int:
        """The number of the document's last array of events; 0 if it is no whole document with one."""
        state = None
        for item in self.walk(path, packed):
            state = item
        return state.number if isinstance(state, State) and not state.inside and state.depth == 0 else 0


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())], names=["path", "ord", "value"])


class TraceArchives(DataSource):
    """path, ord, value: the events of each archive's largest JSON member; value is null where there is no such document."""

    @classmethod
    def name(cls) -> str:
        return ARCHIVES

    def schema(self) -> str:
        return "path string, ord long, value string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["paths"].split("\n"))


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


class SqliteReader(DataSourceReader):
    def __init__(self, paths: list[str], table: str, schema: StructType, rows: int, wanted: dict[str, list[str]]) -> None:
        self.paths, self.table, self.schema, self.rows = paths, table, schema, rows
        # Spark shares what a Python source's filters were between all uses of a frame in a query, so they can't be handed down by themselves
        self.where = [f"{quoted(c)} IN ({', '.join('?' * len(v))})" for c, v in wanted.items()]
        self.values = [x for v in wanted.values() for x in v]

    def opened(self, uri: str) -> sqlite3.Connection:
        path = local_path(uri)
        if path is None:
            raise ValueError(f"{uri}: SQLite files must lie in a folder that all executors have")
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def partitions(self) -> list[Rows]:
        found = []
        for path in self.paths:
            db = self.opened(path)
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            db.close()
            found += [Rows(path, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)] if low is not None else []
        return found or [Rows(self.paths[0], 1, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        db = self.opened(partition.path)
        there = {r[1] for r in db.execute(f"PRAGMA table_info({quoted(self.table)})")}
        shown = ", ".join(quoted(f.name) if f.name in there else "NULL" for f in self.schema)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        kinds = [f.dataType for f in self.schema]
        for row in db.execute(f"SELECT {shown} FROM {quoted(self.table)} WHERE {where}", [partition.first, partition.last, *self.values]):
            yield tuple(map(as_kind, row, kinds))
        db.close()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def as_kind(value, kind):
    """A SQLite value as Spark's kind: times are written as text, truths as numbers. What can't be read is null."""
    if value is None:
        return None
    if isinstance(kind, TimestampType):
        try:
            return dt.datetime.fromisoformat(str(value))
        except ValueError:
            return None
    if isinstance(kind, BooleanType):
        return value not in (0, "0", "", "false")
    return str(value) if isinstance(kind, StringType) else value


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return SQLITE

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(json.loads(self.options["paths"]), self.options["table"], schema, int(self.options.get("rows", ROWS)), json.loads(self.options.get("wanted", "{}")))
