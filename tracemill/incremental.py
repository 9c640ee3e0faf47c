"""Stored facts of many traces that are kept up to date trace by trace.

A store has the tables of an Analysis, partitioned by version and trace, and a manifest: which traces it has, in which
version each, and what its file looked like. An update analyses the traces that are new or whose file has changed,
writes them as a new version, and then puts a new manifest in place by one rename. Readers go by the last manifest, so they see all of an
update or nothing of it; an update that fails leaves files that nothing names. All that is derived (means, families,
comparisons) comes from the facts of the traces asked for, and Spark reads the folders of those alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import Analysis, analyse
from .sources.traces import decoded, read_traces, trace_ids
from .store import file_system

TABLES = ("traces", "steps", "facts", "types", "calls")


class FactStore:
    """Facts below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifests(self) -> list[tuple[int, str]]:
        fs, at = file_system(self.spark, f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((int(n.removesuffix(".json")), f"{self.folder}/manifests/{n}") for n in names if n.removesuffix(".json").isdigit() and n.endswith(".json"))

    def manifest(self) -> tuple[int, dict[str, dict]]:
        """The last manifest's number and, by trace, its version and its file's look; 0 and nothing before the first update."""
        if not (found := self._manifests()):
            return 0, {}
        number, path = found[-1]
        return number, json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _put(self, number: int, entries: dict[str, dict]) -> None:
        fs, aside = file_system(self.spark, f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(entries).encode()))
        out.close()
        to = file_system(self.spark, f"{self.folder}/manifests/{number}.json")[1]
        # another update may have come first: then neither its traces nor these are lost
        if fs.exists(to) or not fs.rename(aside, to):
            fs.delete(aside, False)
            raise RuntimeError(f"{self.folder} was updated meanwhile: do it again")

    def update(self, events: DataFrame, patterns: Sequence[str] = (), looks: dict[str, str] | None = None) -> list[str]:
        """Adds the traces of ``events``, in the place of those of equal id; the others aren't touched. The ids, in order."""
        number, entries = self.manifest()
        version = uuid.uuid4().hex
        found = analyse(events, patterns)
        for name, df in zip(TABLES, (found.traces.withColumn("known", F.lit(True)), found.steps, found.facts, found.types, found.calls)):
            df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "trace_id").parquet(f"{self.folder}/{name}")
        ids = sorted(r["trace_id"] for r in self._table("traces", [(version, None)]).select("trace_id").collect())
        self._put(number + 1, entries | {i: {"version": version, "look": (looks or {}).get(i)} for i in ids})
        return ids

    def update_files(self, *paths: str, patterns: Sequence[str] = ()) -> list[str]:
        """Brings the store up to date with trace files: only files that are new or look otherwise (size, time of change) than at the last update are read. Ids as of ``read_traces`` for all files together."""
        files = self.spark.read.format("binaryFile").load([*paths]).select("path", "length", F.unix_micros("modificationTime").alias("time"))
        looks = {r["path"]: f"{r['length']} {r['time']}" for r in files.select(decoded(F.col("path")).alias("path"), "length", "time").collect()}
        ids = trace_ids(sorted(looks))
        _, entries = self.manifest()
        changed = [f for f in sorted(looks) if entries.get(ids[f], {}).get("look") != looks[f]]
        if not changed:
            return []
        # ids of the whole set, which those of the changed files alone may not tell apart
        alone = trace_ids(changed)
        renamed = {alone[f]: ids[f] for f in changed if alone[f] != ids[f]}
        events = read_traces(self.spark, *changed)
        if renamed:
            names = F.create_map(*(F.lit(x) for pair in renamed.items() for x in pair))
            events = events.withColumn("trace_id", F.coalesce(names[F.col("trace_id")], "trace_id"))
        return self.update(events, patterns, {ids[f]: looks[f] for f in changed})

    def remove(self, *ids: str) -> None:
        number, entries = self.manifest()
        self._put(number + 1, {i: e for i, e in entries.items() if i not in ids})

    def clean(self) -> None:
        """Deletes what the last manifest doesn't name: replaced versions and what failed updates left. Not while an update or a reader of older manifests is at work."""
        number, entries = self.manifest()
        used: dict[str, set[str]] = {}
        for i, e in entries.items():
            used.setdefault(e["version"], set()).add(i)
        for name in TABLES:
            fs, at = file_system(self.spark, f"{self.folder}/{name}")
            for version in fs.listStatus(at) if fs.exists(at) else []:
                if version.getPath().getName().partition("=")[2] not in used:
                    fs.delete(version.getPath(), True)
        for n, path in self._manifests():
            if n < number:
                fs, at = file_system(self.spark, path)
                fs.delete(at, False)

    def _table(self, name: str, versions: list[tuple[str, list[str] | None]]) -> DataFrame:
        """Rows of some versions, each of all or of some traces: filters on folders only."""
        schema = _schemas(self.spark)[name]
        read = self.spark.read.schema(f"{schema}, version string, trace_id string").parquet(f"{self.folder}/{name}")

        def of(version: str, ids: list[str] | None) -> Column:
            one = F.col("version") == version
            return one if ids is None else one & F.col("trace_id").isin(ids)

        return read.filter(reduce(Column.__or__, (of(*v) for v in versions), F.lit(False)))

    def analysis(self, *ids: str) -> Analysis:
        """The stored traces, or some of them. A trace that isn't there raises KeyError."""
        _, entries = self.manifest()
        versions: dict[str, list[str]] = {}
        for i in ids or entries:
            versions.setdefault(entries[i]["version"], []).append(i)
        frames = [self._table(name, sorted(versions.items())).drop("version") for name in TABLES]
        return Analysis(frames[0].select("trace_id"), *frames[1:])


def _schemas(spark: SparkSession) -> dict[str, str]:
    """The columns of each table but trace_id and version."""
    from .schema import EVENTS

    empty = analyse(spark.createDataFrame([], EVENTS))
    every = dict(zip(TABLES, (empty.traces.withColumn("known", F.lit(True)), empty.steps, empty.facts, empty.types, empty.calls)))
    return {name: ", ".join(f"{c} {kind}" for c, kind in df.dtypes if c != "trace_id") for name, df in every.items()}
