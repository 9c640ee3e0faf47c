"""Means over all steps of a trace, families, shares and hotspots. All frames are small: a row per step, name or family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .families import COLLECTIVE, OTHER, family
from .steps import ATEN, COMM, KERNEL

#: The nine metrics of a step, in the order of reports.
METRICS = ("step_dur_ms", "kernels", "compute_dur_ms", "triton", "triton_dur_ms", "aten_ops", "aten_dur_ms", "cncl", "cncl_dur_ms")


def step_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("trace_id").agg(F.count("*").alias("n_steps"))


def name_avg(facts: DataFrame, steps: DataFrame, kind: str) -> DataFrame:
    """trace_id, name, avg_count, avg_dur_ms: sums over a trace's steps, divided by the number of all its steps."""
    sums = facts.filter(F.col("kind") == kind).groupBy("trace_id", "name").agg(F.sum("count").alias("count"), F.sum("dur_ms").alias("dur_ms"))
    return _per_step(sums, steps, ["name"], {"count": "avg_count", "dur_ms": "avg_dur_ms"})


def _per_step(sums: DataFrame, steps: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    return sums.join(step_counts(steps), "trace_id").select("trace_id", *keys, *((F.col(c) / F.col("n_steps")).alias(to) for c, to in columns.items()))


def ordered(averages: DataFrame) -> DataFrame:
    """By falling duration; names settle ties."""
    return averages.orderBy("trace_id", F.desc("avg_dur_ms"), "name")


def with_us_per_call(averages: DataFrame) -> DataFrame:
    return averages.withColumn("avg_us_per_call", F.when(F.col("avg_count") > 0, F.col("avg_dur_ms") / F.col("avg_count") * 1000))


def step_stats(facts: DataFrame, steps: DataFrame) -> DataFrame:
    """trace_id, step and METRICS of every step; steps without events have zeros. The computing time is that of kernels less that of communication annotations."""

    def total(column: str, *conditions: Column) -> Column:
        return F.coalesce(F.sum(F.when(reduce(lambda a, b: a & b, conditions), F.col(column))), F.lit(0))

    is_kernel, is_triton = F.col("kind") == KERNEL, F.col("name").startswith("triton_")
    is_aten, is_comm = F.col("kind") == ATEN, F.col("kind") == COMM
    sums = facts.groupBy("trace_id", "step").agg(
        total("count", is_kernel).alias("kernels"),
        (total("dur_ms", is_kernel) - total("dur_ms", is_comm)).alias("compute_dur_ms"),
        total("count", is_kernel, is_triton).alias("triton"),
        total("dur_ms", is_kernel, is_triton).alias("triton_dur_ms"),
        total("count", is_aten).alias("aten_ops"),
        total("dur_ms", is_aten).alias("aten_dur_ms"),
        total("count", is_comm).alias("cncl"),
        total("dur_ms", is_comm).alias("cncl_dur_ms"),
    )
    joined = steps.select("trace_id", "step", F.col("dur_ms").alias("step_dur_ms")).join(sums, ["trace_id", "step"], "left")
    return joined.select("trace_id", "step", "step_dur_ms", *(F.coalesce(c, F.lit(0)).alias(c) for c in METRICS[1:]))


def step_mean(stats: DataFrame) -> DataFrame:
    """trace_id and the mean of METRICS over a trace's steps."""
    return stats.groupBy("trace_id").agg(*(F.avg(c).alias(c) for c in METRICS))


def mean_or_zero(stats: DataFrame) -> DataFrame:
    """One row of means over all rows: zeros where there are none."""
    return stats.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in METRICS))


def triton_avg(calls: DataFrame, steps: DataFrame) -> DataFrame:
    """trace_id, name, avg_count, avg_dur_ms, avg_io_gb, avg_io_eff: zero-filled means of sums per step. A call without io_gb adds to neither of the last two, one without io_eff adds 0."""
    has = F.col("io_gb").isNotNull()
    sums = calls.groupBy("trace_id", F.col("kernel_name").alias("name")).agg(
        F.count("*").alias("count"),
        (F.sum(F.round(F.coalesce("dur_ms", F.lit(0.0)) * 1e6).cast("long")) / F.lit(1e6)).alias("dur_ms"),
        F.coalesce(F.sum(F.when(has, F.col("io_gb"))), F.lit(0.0)).alias("io_gb"),
        F.coalesce(F.sum(F.when(has, F.col("io_eff"))), F.lit(0.0)).alias("io_eff"),
    )
    return _per_step(sums, steps, ["name"], {"count": "avg_count", "dur_ms": "avg_dur_ms", "io_gb": "avg_io_gb", "io_eff": "avg_io_eff"})


def triton_share(averages: DataFrame) -> DataFrame:
    """triton_avg with dur_pct of all Triton time and avg_us_per_call."""
    total = F.sum("avg_dur_ms").over(Window.partitionBy("trace_id"))
    return with_us_per_call(averages.withColumn("dur_pct", F.col("avg_dur_ms") / _or_one(total) * 100))


def _or_one(total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(total)


def is_compute() -> Column:
    """Of rows with family and avg_dur_ms: no collective. Only rows with a mean count, which all have: as it depends on a sum, Spark can't apply it, and classify names, below the aggregation on every event."""
    return F.when(F.col("avg_dur_ms").isNotNull(), F.col("family") != COLLECTIVE)


def with_family(averages: DataFrame) -> DataFrame:
    """Adds the family of each name: names are few, events are many."""
    return averages.withColumn("family", family(F.col("name")))


def kernel_share(averages: DataFrame) -> DataFrame:
    """Kernel means with family, count_pct, dur_pct and avg_us_per_call: collectives as shares of all kernels, the others of all but collectives."""
    named = with_family(averages)
    is_collective = F.col("family") == COLLECTIVE

    def share(column: str) -> Column:
        trace = Window.partitionBy("trace_id")
        every, compute = F.sum(column).over(trace), F.sum(F.when(~is_collective, F.col(column)).otherwise(0.0)).over(trace)
        return F.col(column) / F.when(is_collective, _or_one(every)).otherwise(_or_one(compute)) * 100

    return with_us_per_call(named.withColumns({"count_pct": share("avg_count"), "dur_pct": share("avg_dur_ms")}))


def family_avg(averages: DataFrame, traces: DataFrame) -> DataFrame:
    """trace_id, family, avg_count, avg_dur_ms of families with time; every trace of ``traces`` (rows with a trace_id), even one without steps, has an ``other``, if need be of zeros."""
    sums = with_family(averages).groupBy("trace_id", "family").agg(F.sum("avg_count").alias("avg_count"), F.sum("avg_dur_ms").alias("avg_dur_ms")).filter("avg_dur_ms > 0")
    always = traces.select("trace_id").distinct().select("trace_id", F.lit(OTHER).alias("family"), F.lit(0.0).alias("avg_count"), F.lit(0.0).alias("avg_dur_ms"))
    return sums.unionByName(always).groupBy("trace_id", "family").agg(F.sum("avg_count").alias("avg_count"), F.sum("avg_dur_ms").alias("avg_dur_ms"))


def family_breakdown(families: DataFrame) -> DataFrame:
    """Families but collectives with their shares of these, rank 1 for the longest and ``other`` last."""
    trace = Window.partitionBy("trace_id")
    compute = families.filter(is_compute())
    shares = {f"{c}_pct": F.col(f"avg_{m}") / _or_one(F.sum(f"avg_{m}").over(trace)) * 100 for c, m in (("count", "count"), ("dur", "dur_ms"))}
    order = [F.col("family") == OTHER, F.desc("avg_dur_ms"), "family"]
    return compute.withColumns(shares).withColumn("sort_rank", F.row_number().over(trace.orderBy(*order)))


def top_kernels(averages: DataFrame, n: int = 10) -> DataFrame:
    """The n longest kernels of each trace but collectives: rank, family, dur_pct of all such kernels, the means and short_name."""
    compute = with_family(averages).filter(is_compute())
    trace = Window.partitionBy("trace_id")
    ranked = compute.withColumn("dur_pct", F.col("avg_dur_ms") / _or_one(F.sum("avg_dur_ms").over(trace)) * 100)
    ranked = ranked.withColumn("rank", F.row_number().over(trace.orderBy(F.desc("avg_dur_ms"), "name"))).filter(F.col("rank") <= n)
    from ..functions.text import shortened

    return ranked.select("trace_id", "rank", "family", "dur_pct", "avg_dur_ms", "avg_count", "name", shortened(F.col("name")).alias("short_name"))
