"""Two traces side by side: full outer joins by name, family or metric, zeros for what one lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .averages import METRICS, is_compute
from .families import OTHER


def pct_change(a: Column, b: Column) -> Column:
    """Percent from a to b; null if a is 0."""
    return F.when(a != 0, (b - a) / a * 100)


def side_by_side(averages: DataFrame, a: str, b: str, key: str, columns: tuple[str, ...]) -> DataFrame:
    """key and each column's values in trace a and in trace b: one pass over both, without a join."""

    def of(trace: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("trace_id") == trace, F.col(column))), F.lit(0.0))

    both = averages.filter(F.col("trace_id").isin(a, b)).groupBy(key)
    return both.agg(*(of(t, c).alias(f"{c}_{side}") for c in columns for side, t in (("A", a), ("B", b))))


def with_change(joined: DataFrame, a: str = "avg_dur_ms_A", b: str = "avg_dur_ms_B") -> DataFrame:
    return joined.withColumns({"delta_dur_ms": F.col(b) - F.col(a), "pct_change": pct_change(F.col(a), F.col(b))})


def compare_names(averages: DataFrame, a: str, b: str) -> DataFrame:
    """name, avg_dur_ms_A/B, delta_dur_ms, pct_change, avg_count_A/B for kernels, ATen operations or communication."""
    return with_change(side_by_side(averages, a, b, "name", ("avg_dur_ms", "avg_count")))


def compare_triton(averages: DataFrame, a: str, b: str) -> DataFrame:
    """The same with avg_io_gb_A/B."""
    return with_change(side_by_side(averages, a, b, "name", ("avg_dur_ms", "avg_count", "avg_io_gb")))


def by_change(compared: DataFrame) -> DataFrame:
    """Largest change first, on the unrounded values; names settle ties."""
    return compared.orderBy(F.desc(F.abs("delta_dur_ms")), "name")


def compare_families(families: DataFrame, a: str, b: str) -> DataFrame:
    """Families but collectives: shares and means of both, change, and sort_rank by their time together, ``other`` last. There is always an ``other``."""
    spark = families.sparkSession
    both = side_by_side(families.filter(is_compute()), a, b, "family", ("avg_dur_ms", "avg_count"))
    none = spark.range(1).select(F.lit(OTHER).alias("family"), *(F.lit(0.0).alias(c) for c in both.columns[1:]))
    both = both.unionByName(none).groupBy("family").agg(*(F.sum(c).alias(c) for c in both.columns[1:]))
    # a row per family: a few dozen whatever the traces' sizes, so one window over all is small
    every = Window.partitionBy(F.lit(0))
    total = {side: F.sum(f"avg_dur_ms_{side}").over(every) for side in "AB"}
    shares = {f"dur_pct_{side}": F.col(f"avg_dur_ms_{side}") / F.when(total[side] == 0, 1.0).otherwise(total[side]) * 100 for side in "AB"}
    rank = F.row_number().over(every.orderBy(F.col("family") == OTHER, F.desc(F.col("avg_dur_ms_A") + F.col("avg_dur_ms_B")), "family"))
    return with_change(both.withColumns(shares)).withColumn("sort_rank", rank)


def compare_metrics(means: DataFrame, a: str, b: str) -> DataFrame:
    """metric, A, B, delta, pct_change of the nine means, with their place."""
    doubles = means.select("trace_id", *(F.col(c).cast("double") for c in METRICS))
    rows = doubles.unpivot(["trace_id"], list(METRICS), "metric", "value")

    def of(trace: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("trace_id") == trace, F.col("value"))), F.lit(0.0))

    both = rows.filter(F.col("trace_id").isin(a, b)).groupBy("metric").agg(of(a).alias("A"), of(b).alias("B"))
    place = F.array_position(F.array(*map(F.lit, METRICS)), F.col("metric")).cast("int")
    return both.select(place.alias("place"), "metric", "A", "B", (F.col("B") - F.col("A")).alias("delta"), pct_change(F.col("A"), F.col("B")).alias("pct_change"))
