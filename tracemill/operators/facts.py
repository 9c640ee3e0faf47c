"""Facts per step: the frame that everything else is derived from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CODE, IO_EFF, IO_GB, KWARGS
from .families import is_collective_by_args, pattern_types
from .steps import COMM, KERNEL, STEP, assigned, routed


def nanoseconds(dur: Column | str = "dur") -> Column:
    """A duration in whole nanoseconds, null as 0. Sums of integers don't depend on the order in which partitions are added."""
    return F.round(F.coalesce(dur, F.lit(0.0)) * 1000).cast("long")


def milliseconds(ns: Column) -> Column:
    return ns / F.lit(1e6)


def placed_events(events: DataFrame, steps: DataFrame) -> DataFrame:
    """Kernels, ATen operations and communication annotations with their kind and step."""
    return assigned(routed(events).filter(F.col("kind") != STEP), steps)


def step_facts(placed: DataFrame) -> DataFrame:
    """trace_id, kind, step, name, count, dur_ms: the one large shuffle, after partial sums in each task."""
    sums = placed.groupBy("trace_id", "kind", "step", "name").agg(F.count("*").alias("count"), F.sum(nanoseconds()).alias("ns"))
    return sums.select("trace_id", "kind", "step", "name", "count", milliseconds(F.col("ns")).alias("dur_ms"))


def type_facts(placed: DataFrame, patterns: Sequence[str] = ()) -> DataFrame:
    """trace_id, step, type, count, dur_ms of kernels by overlapping types: a Triton kernel counts as such and again for each pattern it contains."""
    kernels = placed.filter(F.col("kind") == KERNEL).groupBy("trace_id", "step", "name", is_collective_by_args(F.col("args")).alias("by_args"))
    # names are classified once a step, not once an event
    sums = kernels.agg(F.count("*").alias("count"), F.sum(nanoseconds()).alias("ns"))
    typed = sums.withColumn("type", F.explode(pattern_types(F.col("name"), F.col("by_args"), [p for p in patterns if p])))
    return typed.groupBy("trace_id", "step", "type").agg(F.sum("count").alias("count"), milliseconds(F.sum("ns")).alias("dur_ms"))


def arg(key: str) -> Column:
    return F.col("args").getField(key)


def triton_calls(placed: DataFrame) -> DataFrame:
    """A row per kernel whose name starts with triton_ (case counts): trace_id, step, ord, kernel_name, dur_ms (null stays), io_gb, io_eff, tiling, code. Numbers that can't be read are null."""
    kernels = placed.filter((F.col("kind") == KERNEL) & F.col("name").startswith("triton_"))
    return kernels.select("trace_id", "step", "ord", F.col("name").alias("kernel_name"), (F.col("dur") / 1000).alias("dur_ms"), arg(IO_GB).try_cast("double").alias("io_gb"), arg(IO_EFF).try_cast("double").alias("io_eff"), arg(KWARGS).alias("tiling"), arg(CODE).alias("code"))


def of_kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.filter(F.col("kind") == kind)


def collectives(facts: DataFrame) -> DataFrame:
    return of_kind(facts, COMM)
