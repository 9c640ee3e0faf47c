"""Routing of events, the table of steps, and the as-of assignment of events to steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import stored

#: Up to so many steps in all, their table is broadcast; beyond, events and steps are swept in order of time.
BROADCAST_STEPS = 2000

STEP, KERNEL, ATEN, COMM = "step", "kernel", "aten", "cncl"


def is_step() -> Column:
    return F.col("name").startswith("ProfilerStep#") & (F.col("cat") == "user_annotation")


def step_number() -> Column:
    """The number after the last #; null if it isn't one."""
    return F.element_at(F.split("name", "#"), -1).try_cast("int")


def kind() -> Column:
    """What an event is: the first that holds of step, kernel, ATen operation and communication annotation; null for others.

    The phase is not looked at. A name test never overrides cat = 'kernel'.
    """
    name, cat = F.col("name"), F.col("cat")
    return (
        F.when(is_step(), STEP)
        .when(cat == "kernel", KERNEL)
        .when(name.startswith("aten::"), ATEN)
        .when((cat == "gpu_user_annotation") & (name.startswith("cncl") | name.startswith("nccl")), COMM)
    )


def routed(events: DataFrame) -> DataFrame:
    """Events of a kind, with their ``kind``."""
    return events.withColumn("kind", kind()).filter(F.col("kind").isNotNull())


def steps(events: DataFrame) -> DataFrame:
    """trace_id, step, ord, start, end, dur_ms, nxt (the next start in order of start and place, if any).

    Of annotations that repeat a number the last one's times hold, in the first one's place. Steps without a readable
    number are dropped.
    """
    dur = F.coalesce("dur", F.lit(0.0))
    found = events.filter(is_step()).select("trace_id", step_number().alias("step"), "ord", F.struct(F.col("ts").alias("start"), (F.col("ts") + dur).alias("end"), (dur / 1000).alias("dur_ms")).alias("t")).filter("step IS NOT NULL")
    one = found.groupBy("trace_id", "step").agg(F.min("ord").alias("ord"), F.max_by("t", "ord").alias("t")).select("trace_id", "step", "ord", "t.*")
    return one.withColumn("nxt", F.lead("start").over(Window.partitionBy("trace_id").orderBy("start", "ord")))


def few(steps: DataFrame, most: int = BROADCAST_STEPS) -> DataFrame:
    """The same steps, as a table of the driver's if they are at most ``most``: then several results need not read the events for them again."""
    rows = steps.limit(most + 1).collect()
    return steps.sparkSession.createDataFrame(rows, steps.schema) if len(rows) <= most else steps


def assigned(events: DataFrame, steps: DataFrame, broadcast_steps: int = BROADCAST_STEPS) -> DataFrame:
    """The events that lie in a step, with ``step``: the latest-starting step with start <= ts, if ts <= its end.

    An event past the end of that step is in none, even if an earlier step still runs. There is at most one match.
    """
    own = steps.select("trace_id", "step", "ord", "start", "end", "nxt")
    e = events.alias("e")
    inside = (F.col("e.ts") >= F.col("s.start")) & (F.col("s.nxt").isNull() | (F.col("e.ts") < F.col("s.nxt"))) & (F.col("e.ts") <= F.col("s.end"))
    same = F.col("e.trace_id") == F.col("s.trace_id")
    if own.limit(broadcast_steps + 1).count() <= broadcast_steps:
        return e.join(F.broadcast(own).alias("s"), same & inside).select("e.*", "s.step")
    return swept(events, own)


def swept(events: DataFrame, steps: DataFrame) -> DataFrame:
    """What ``assigned`` gives, for any number of steps and however they and the events cluster in time.

    Events and steps go together into ranges of trace, time and place, a task each, of about equal numbers of rows. In
    its range every event takes the last step before it; where there is none, the last step of an earlier range.
    """
    columns = [F.col(f"e.`{c}`") for c in events.columns]
    e = events.select("trace_id", F.col("ts").alias("at"), F.lit(1).alias("turn"), F.col("ord").alias("place"), F.struct(*(F.col(f"`{c}`") for c in events.columns)).alias("e"), F.lit(None).cast("struct<step:int,end:double,trace:string>").alias("s"))
    # of steps of equal start the one of greatest place is the last; a step comes before events at its start
    own = steps.select("trace_id", F.col("start").alias("at"), F.lit(0).alias("turn"), F.col("ord").alias("place"), F.lit(None).cast(e.schema["e"].dataType).alias("e"), F.struct("step", "end", F.col("trace_id").alias("trace")).alias("s"))
    order = ["trace_id", "at", "turn", "place"]
    ranged = stored(e.unionByName(own).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "sweep")
    # a row a range
    lasts = ranged.filter("s IS NOT NULL").groupBy("range").agg(F.max_by("s", F.struct(*order)).alias("s"))
    handed = ranged.select("range").distinct().join(lasts, "range", "left")
    before = handed.select("range", F.last("s", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    within = F.last("s", ignorenulls=True).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = ranged.withColumn("last", within).filter("turn = 1").join(F.broadcast(before), "range").withColumn("last", F.coalesce("last", "before"))
    return found.filter("last.trace = trace_id AND at <= last.end").select(*columns, F.col("last.step").alias("step"))
