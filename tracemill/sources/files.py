"""Files under names of their own, written by tasks and shown by a commit.

A data source whose rows are (file, text): the file's path below the target folder, and a piece of its content; pieces of
a file follow each other within a partition. Each attempt of a task writes whole files under their final names in a
folder of its own beside the others; only when all tasks have ended well are the folders' entries put in place, an entry a
step or a folder of code, not a file. Before that nothing is seen, and after a failure neither. What an entry replaces is set aside first
and comes back if the commit fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "named_files"
STAGED = ".staged-"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A path or URI as a file system and a path there."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def kind_of(fs: pafs.FileSystem, path: str) -> pafs.FileType:
    return fs.get_file_info(path).type


@dataclass
class Written(WriterCommitMessage):
    """Where a task's files are, and the names of what lies at the top there."""

    folder: str
    entries: list[str]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.staged = f"{self.path}/{STAGED}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Any]) -> Written:
        fs, staged = opened(self.staged)
        folder = f"{staged}/{uuid.uuid4().hex}"
        entries: set[str] = set()
        seen: set[str] = set()
        name, out = None, None
        try:
            for row in iterator:
                if row["file"] != name:
                    if out:
                        out.close()
                    name = row["file"]
                    if name in seen or ".." in name.split("/") or name.startswith("/"):
                        raise ValueError(f"pieces of {name} must follow each other, below the target")
                    seen.add(name)
                    top, _, rest = name.partition("/")
                    if top not in entries or rest:
                        fs.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
                    entries.add(top)
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(bytes(row["text"]))
        finally:
            if out:
                out.close()
        return Written(folder, sorted(entries))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = opened(self.path)
        staged = opened(self.staged)[1]
        moves = [(f"{m.folder}/{e}", f"{path}/{e}") for m in messages if m for e in m.entries]
        if len({to for _, to in moves}) < len(moves):
            raise ValueError("a folder's files must be in one partition")
        for source, to in moves:
            there = kind_of(fs, to)
            if there not in (pafs.FileType.NotFound, kind_of(fs, source)):
                raise ValueError(f"{to} is a folder, or in the place of one")
        done: list[tuple[str, str]] = []
        try:
            fs.create_dir(f"{staged}/before", recursive=True)
            for source, to in moves:
                if kind_of(fs, to) != pafs.FileType.NotFound:
                    aside = f"{staged}/before/{to.rpartition('/')[2]}"
                    fs.move(to, aside)
                    done.append((to, aside))
                fs.move(source, to)
                done.append((source, to))
                # Spark's local file system keeps checksums beside files, which would no longer be right
                sums = "/.".join(f"{to}.crc".rsplit("/", 1))
                if isinstance(fs, pafs.LocalFileSystem) and kind_of(fs, sums) == pafs.FileType.File:
                    fs.delete_file(sums)
        except Exception:
            for source, to in reversed(done):
                fs.move(to, source)
            raise
        fs.delete_dir(staged)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, staged = opened(self.staged)
        if kind_of(fs, staged) == pafs.FileType.Directory:
            fs.delete_dir(staged)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, text binary"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def write_files(rows: DataFrame, path: str, *order: str) -> None:
    """Writes rows (file, text; text or bytes) below ``path``; pieces of a file in ``order``. All files below one folder are one task's, of which it holds a row at a time."""
    write_pieces(rows.repartition(F.split("file", "/")[0]).sortWithinPartitions("file", *order), path)


def write_pieces(rows: DataFrame, path: str) -> None:
    """Writes rows (file, text; text or bytes) whose pieces of a file follow each other within a partition, as they come."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("file", F.col("text").cast("binary").alias("text")).write.format(FORMAT).mode("append").save(path)
