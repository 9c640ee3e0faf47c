"""Reading profiler traces into the canonical events frame."""

from __future__ import annotations

import re
from collections import Counter
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENTS, RAW_EVENT, TRACE
from .archives import ARCHIVES, TraceArchives
from .split_json import split_elements


class InvalidTrace(ValueError):
    """A file that is no trace document, or in strict mode holds an event that can't be placed."""


_MARK = "not a trace document: "


_ENDING = r"(\.(json|gz|tar|tgz))+$"


def decoded(uri: Column) -> Column:
    """A file's URI with its %20 and the like as characters."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def trace_name(path: Column) -> Column:
    """The file's name without folders and without .json, .gz, .tar and .tgz."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), _ENDING, "")


def trace_ids(files: list[str]) -> dict[str, str]:
    """An id for each of some files: its name without ending, and as many of the folders before it as tell it from the others."""
    parts = {f: re.sub(_ENDING, "", f).split("/") for f in dict.fromkeys(files)}
    out, depth, left = {}, 1, list(parts)
    while left:
        named = {f: "/".join(parts[f][-depth:]) for f in left}
        counts = Counter(named.values())
        # where even whole paths are the same but for the ending, the file's whole name tells
        done = [f for f in left if counts[named[f]] == 1 or depth > len(parts[f])]
        out |= {f: named[f] if counts[named[f]] == 1 else f for f in done}
        left, depth = [f for f in left if f not in out], depth + 1
    return out


def trace_files(spark: SparkSession, *paths: str) -> list[str]:
    """The files that ``paths`` (files, folders, patterns) name, decoded, in their order."""
    return list(dict.fromkeys(unquote(f) for p in paths for f in sorted(spark.read.text(p, wholetext=True).inputFiles())))


def with_ids(rows: DataFrame, files: list[str]) -> DataFrame:
    """Adds trace_id to rows with a path. A table of ids is joined only where names repeat; it has a row a file."""
    ids = trace_ids(files)
    named = rows.withColumn("path", decoded(F.col("path")))
    if all(re.sub(_ENDING, "", f.rpartition("/")[2]) == i for f, i in ids.items()):
        return named.withColumn("trace_id", trace_name(F.col("path")))
    known = rows.sparkSession.createDataFrame(list(ids.items()), "path string, trace_id string")
    return named.join(F.broadcast(known), "path")


def documents_to_events(texts: DataFrame) -> DataFrame:
    """EVENTS of rows (trace_id, path, value), a whole JSON document each.

    Missing and null names and categories are empty, a missing or null ts is 0; a null dur stays null. Unknown keys are
    skipped by the parser. A document without traceEvents fails the query when it is read.
    """
    parsed = texts.select("trace_id", F.from_json("value", TRACE).alias("doc"), "path")
    checked = F.when(F.col("doc.traceEvents").isNotNull(), F.col("doc.traceEvents")).otherwise(F.raise_error(F.concat(F.lit(_MARK), "path")).cast(TRACE["traceEvents"].dataType))
    rows = parsed.select("trace_id", F.posexplode(checked).alias("ord", "e"))
    return normalized(rows.select("trace_id", F.col("ord").cast("long").alias("ord"), "e.*"))


def normalized(events: DataFrame) -> DataFrame:
    """Defaults of the canonical frame for rows with its columns."""
    return events.select("trace_id", "ord", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("cat", F.lit("")).alias("cat"), F.coalesce("ts", F.lit(0.0)).alias("ts"), "dur", "args")


def read_traces(spark: SparkSession, *paths: str) -> DataFrame:
    """EVENTS of JSON trace files, plain or gzipped by extension, a file a trace, with ``trace_ids`` of all files. A path given twice counts once.

    A file is one document and so one task; its text is limited to 2 GB. Ingest once (``ingest_traces``) and read
    Parquet from then on; larger files are for ``read_large_traces``, which splits them.
    """
    texts = spark.read.text([*dict.fromkeys(paths)], wholetext=True).select(F.input_file_name().alias("path"), "value")
    return documents_to_events(with_ids(texts, trace_files(spark, *paths)))


def read_large_traces(spark: SparkSession, *paths: str) -> DataFrame:
    """What read_traces gives, of files of any size: a plain file is read by as many tasks as it has byte ranges.

    Two passes over the files run at once; a file that isn't a whole trace document raises InvalidTrace then. An element
    that isn't JSON fails the query when it is read.
    """
    try:
        rows = split_elements(spark, [*dict.fromkeys(paths)])
    except ValueError as e:
        raise InvalidTrace(str(e)) from None
    return elements_to_events(with_ids(rows, trace_files(spark, *paths)))


def elements_to_events(rows: DataFrame) -> DataFrame:
    """EVENTS of rows (trace_id, path, ord, value), an element of a document's array each."""
    right = F.json_object_keys("value").isNotNull() | F.col("value").rlike(r"^\s*null\s*$")
    checked = F.when(right, F.col("value")).otherwise(F.raise_error(F.concat(F.lit(_MARK), "path")))
    parsed = rows.select("trace_id", "ord", F.from_json(checked, RAW_EVENT).alias("e"))
    return normalized(parsed.select("trace_id", "ord", "e.*"))


def read_event_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """EVENTS of files with a JSON event a line, which Spark splits at will; ord follows the lines within a partition, partitions follow each other."""
    lines = spark.read.schema(RAW_EVENT).json([*dict.fromkeys(paths)])
    return normalized(with_ids(lines.withColumn("path", F.input_file_name()), trace_files(spark, *paths)).withColumns({"ord": F.monotonically_increasing_id()}))


def read_trace_archives(spark: SparkSession, *paths: str) -> DataFrame:
    """EVENTS of tar or tar.gz files: of each the largest .json member, streamed by one task however large it is. An archive without one, or whose member is no trace document, fails the query when it is read."""
    files = trace_files(spark, *paths)
    spark.dataSource.register(TraceArchives)
    rows = spark.read.format(ARCHIVES).option("paths", "\n".join(files)).load()
    return elements_to_events(with_ids(rows, files))


def strict_problems(events: DataFrame) -> DataFrame:
    """Rows that a strict reading refuses: step annotations whose number can't be read."""
    from ..operators.steps import is_step, step_number

    return events.filter(is_step() & step_number().isNull()).select("trace_id", "ord", "name")


def ingest_traces(events: DataFrame, out: str, strict: bool = False) -> DataFrame:
    """Writes events to Parquet by trace and returns the store as read from there; raises InvalidTrace where a document is none. Of the store's traces those that ``events`` has are replaced, the others stay.

    Readers of some traces then prune the others' folders, and filters and needed columns reach the scan.
    """
    spark = events.sparkSession
    try:
        events.write.partitionBy("trace_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)
    except PySparkException as e:
        if _MARK in str(e):
            raise InvalidTrace(str(e).partition(_MARK)[2].splitlines()[0]) from None
        raise
    stored = spark.read.schema(EVENTS).parquet(out).select(*EVENTS.names)
    if strict and (bad := strict_problems(stored).first()):
        raise InvalidTrace(f"{bad['trace_id']}, event {bad['ord']}: {bad['name']}")
    return stored
