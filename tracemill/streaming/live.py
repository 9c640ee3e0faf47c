"""Totals of events that arrive while a run goes on; an extension, not something the original tool has.

Steps must be there before the events of theirs, or be known from an earlier run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import milliseconds, nanoseconds, placed_events
from ..schema import EVENTS


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """EVENTS with a JSON event a line from files that appear in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def running_facts(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Running count and duration by trace, kind, step and name; for output mode update or complete."""
    placed = placed_events(events, steps)
    return placed.groupBy("trace_id", "kind", "step", "name").agg(F.count("*").alias("count"), milliseconds(F.sum(nanoseconds())).alias("dur_ms"))


def windowed_facts(events: DataFrame, length: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Count and duration by window of event time, with a watermark, for output mode append."""
    timed = events.withColumn("time", F.timestamp_micros(F.col("ts").cast("long"))).withWatermark("time", late)
    sums = timed.groupBy(F.window("time", length), "trace_id", "name").agg(F.count("*").alias("count"), milliseconds(F.sum(nanoseconds())).alias("dur_ms"))
    return sums.select("trace_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "name", "count", "dur_ms")
