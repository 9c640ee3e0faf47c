"""Facts of traces whose events and steps arrive in any order.

State by trace: its steps so far, and its events that aren't counted yet. Nothing is counted while a trace still
grows, as a step that comes later may claim an event. When a trace has been quiet for ``wait`` its events are assigned as
in a batch and summed, and let go; its steps stay, so what comes after that is counted too, as further rows: the sums by
step and name are those of a batch over all events, but where a step itself comes after its events were counted.
Needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.facts import nanoseconds
from ..operators.steps import STEP, routed, step_number

FACTS = "trace_id string, kind string, step int, name string, count long, ns long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Must be called before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def step_sums(events: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """kind, step, name, count, ns: events (kind, name, ts, ns) in their latest-starting step, if they aren't past its end. Of steps that repeat a number the last by ord has the times, the first the place."""
    place = steps.groupby("step")["ord"].transform("min")
    own = steps.assign(place=place).sort_values("ord").drop_duplicates("step", keep="last").sort_values(["start", "place"])
    if own.empty or events.empty:
        return pd.DataFrame({"kind": [], "step": [], "name": [], "count": [], "ns": []})
    at = np.searchsorted(own["start"].to_numpy(), events["ts"].to_numpy(), side="right") - 1
    inside = (at >= 0) & (events["ts"].to_numpy() <= own["end"].to_numpy()[at])
    found = events[inside].assign(step=own["step"].to_numpy()[at[inside]])
    return found.groupby(["kind", "step", "name"], as_index=False).agg(count=("ns", "size"), ns=("ns", "sum"))


class QuietTraces(StatefulProcessor):
    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "kind string, name string, ts double, ns long")
        self.steps = handle.getListState("steps", "step int, ord long, start double, end double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            is_step = batch["kind"] == STEP
            if len(steps := batch[is_step & batch["step"].notna()]):
                self.steps.appendList(list(steps[["step", "ord", "ts", "end"]].astype({"step": int}).itertuples(index=False, name=None)))
            if len(events := batch[~is_step]):
                self.events.appendList(list(events[["kind", "name", "ts", "ns"]].itertuples(index=False, name=None)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = pd.DataFrame(list(self.events.get()), columns=["kind", "name", "ts", "ns"])
        steps = pd.DataFrame(list(self.steps.get()), columns=["step", "ord", "start", "end"])
        self.events.clear()
        out = step_sums(events, steps)
        if len(out):
            yield out.assign(trace_id=key[0])[["trace_id", "kind", "step", "name", "count", "ns"]]

    def close(self) -> None:
        pass


def quiet_facts(events: DataFrame, wait_seconds: float = 600) -> DataFrame:
    """FACTS of a stream of EVENTS, for output mode append: rows to add up by trace, kind, step and name."""
    end = F.col("ts") + F.coalesce("dur", F.lit(0.0))
    rows = routed(events).select("trace_id", "kind", "name", "ord", "ts", end.alias("end"), nanoseconds().alias("ns"), F.when(F.col("kind") == STEP, step_number()).alias("step"))
    return rows.groupBy("trace_id").transformWithStateInPandas(QuietTraces(round(wait_seconds * 1000)), FACTS, "append", "ProcessingTime")


def summed(facts: DataFrame) -> DataFrame:
    """Rows of quiet_facts added up to the step facts of a batch: trace_id, kind, step, name, count, dur_ms."""
    return facts.groupBy("trace_id", "kind", "step", "name").agg(F.sum("count").alias("count"), (F.sum("ns") / F.lit(1e6)).alias("dur_ms"))
