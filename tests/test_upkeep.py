"""Stores kept up to date, and streams in any order, against batches over everything."""

from __future__ import annotations

import json
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.analysis import analyse
from tracemill.incremental import FactStore
from tracemill.operators import compare as C
from tracemill.operators import facts as X
from tracemill.operators import steps as S
from tracemill.schema import EVENTS
from tracemill.sources import traces
from tracemill.streaming import live, stateful


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def trace(seed, n=40):
    rng = random.Random(seed)
    steps = [{"name": f"ProfilerStep#{k}", "cat": "user_annotation", "ts": 100 * k, "dur": rng.randrange(60, 120)} for k in range(4)]
    rows = [{"name": f"{rng.choice(['triton_poi_x', 'gemm', 'aten::add'])}{rng.randrange(3)}", "cat": "kernel", "ts": rng.randrange(500), "dur": rng.randrange(9), "args": {"triton output code": "x"}} for _ in range(n)]
    rows += steps + [dict(steps[1], dur=7)]
    rng.shuffle(rows)
    return rows


def write(path, seed):
    path.write_text(json.dumps({"traceEvents": trace(seed)}))
    os.utime(path, (seed * 1000, seed * 1000))


def same(stored, whole):
    for name in ("traces", "steps", "facts", "types", "calls"):
        assert rows_of(getattr(stored, name)) == rows_of(getattr(whole, name)), name


def test_updates_equal_a_full_run(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    paths = [folder / f"t{k}.json" for k in range(4)]
    for k, p in enumerate(paths[:3]):
        write(p, k)
    store = FactStore(spark, str(tmp_path / "store"))
    assert store.update_files(str(folder)) == ["t0", "t1", "t2"]
    assert store.update_files(str(folder)) == []
    full = lambda: analyse(traces.read_traces(spark, str(folder)))
    same(store.analysis(), full())
    # one more trace, and one that changed: only these are read
    write(paths[3], 3)
    write(paths[1], 11)
    before = store.manifest()[1]
    assert store.update_files(str(folder)) == ["t1", "t3"]
    after = store.manifest()[1]
    assert after["t0"] == before["t0"] and after["t2"] == before["t2"] and after["t1"]["version"] == after["t3"]["version"] != before["t1"]["version"]
    same(store.analysis(), full())
    assert rows_of(C.compare_names(store.analysis().kernels, "t0", "t3")) == rows_of(C.compare_names(full().kernels, "t0", "t3"))
    # readers of some traces read their folders only
    plan = store.analysis("t3").facts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in plan and "isnotnull(trace_id" in plan
    one = store.analysis("t3").facts
    assert len({f.rpartition("/")[0] for f in one.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}) == 1
    store.remove("t0")
    store.clean()
    assert rows_of(store.analysis().traces) == ["Row(trace_id='t1')", "Row(trace_id='t2')", "Row(trace_id='t3')"]
    with pytest.raises(KeyError):
        store.analysis("t0")


def test_a_failed_update_changes_nothing(spark, tmp_path):
    write(tmp_path / "a.json", 1)
    store = FactStore(spark, str(tmp_path / "store"))
    events = traces.read_traces(spark, str(tmp_path / "a.json"))
    store.update(events)
    before = rows_of(store.analysis().facts), store.manifest()
    with pytest.raises(Exception, match="broken"):
        store.update(events.withColumn("name", F.when(F.col("ord") < 40, F.col("name")).otherwise(F.raise_error(F.lit("broken")))))
    assert (rows_of(store.analysis().facts), store.manifest()) == before
    # of two updates from one manifest the second is refused
    number, entries = store.manifest()
    store._put(number + 1, entries)
    with pytest.raises(RuntimeError):
        store._put(number + 1, {})
    assert store.manifest()[1] == entries


def test_store_of_equal_names(spark, tmp_path):
    for k in "ab":
        (tmp_path / k).mkdir()
        write(tmp_path / k / "run.json", ord(k))
    store = FactStore(spark, str(tmp_path / "store"))
    assert store.update_files(str(tmp_path / "a/run.json"), str(tmp_path / "b/run.json")) == ["a/run", "b/run"]
    write(tmp_path / "b/run.json", 5)
    assert store.update_files(str(tmp_path / "a/run.json"), str(tmp_path / "b/run.json")) == ["b/run"]
    same(store.analysis(), analyse(traces.read_traces(spark, str(tmp_path / "a/run.json"), str(tmp_path / "b/run.json"))))


def test_empty_store(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    assert store.manifest() == (0, {})
    assert store.update(spark.createDataFrame([], EVENTS)) == [] and store.analysis().facts.count() == 0


def test_stream_in_any_order(spark, tmp_path):
    """Batches in random order, and a restart from the checkpoint between them, against a batch over all."""
    rng = random.Random(7)
    rows = [{**e, "trace_id": f"t{k}", "ord": i} for k in range(2) for i, e in enumerate(trace(k))]
    rng.shuffle(rows)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    settings = {"spark.sql.streaming.stateStore.providerClass": stateful.ROCKSDB, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        parts = [rows[k::5] for k in range(5)]
        events = None
        for begin, end in ((0, 3), (3, 5)):
            for k in range(begin, end):
                (folder / f"{k}.json").write_text("\n".join(map(json.dumps, parts[k])))
            events = traces.normalized(spark.read.schema(EVENTS).json(str(folder)))
            wanted = rows_of(X.step_facts(X.placed_events(events, S.steps(events)))) if end == 5 else None
            query = stateful.quiet_facts(live.event_stream(spark, str(folder), 1), 2).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").format("parquet").start(out)
            read, limit = 0, time.time() + 90
            while time.time() < limit:
                assert query.exception() is None
                read = max(read, sum({p.batchId: p.numInputRows for p in query.recentProgress}.values()))
                if end < 5 and read >= sum(map(len, parts[begin:end])):
                    break
                if end == 5 and rows_of(stateful.summed(spark.read.schema(stateful.FACTS).parquet(out))) == wanted:
                    break
                time.sleep(0.5)
            query.stop()
        assert rows_of(stateful.summed(spark.read.schema(stateful.FACTS).parquet(out))) == wanted
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_step_sums_of_repeated_steps():
    steps = pd.DataFrame([(1, 5, 0.0, 9.0), (1, 8, 50.0, 60.0), (2, 6, 50.0, 55.0)], columns=["step", "ord", "start", "end"])
    events = pd.DataFrame([("kernel", "a", 52.0, 1), ("kernel", "a", 58.0, 2), ("kernel", "b", 5.0, 4)], columns=["kind", "name", "ts", "ns"])
    # step 1 has its last times in its first place, so step 2 starts later
    assert stateful.step_sums(events, steps).values.tolist() == [["kernel", 2, "a", 1, 1]]
    assert stateful.step_sums(events, steps[:0]).empty and stateful.step_sums(events[:0], steps).empty


def test_comparison_reads_events_once_for_all_its_tables(spark, monkeypatch):
    """The report's six tables come from facts that are stored: the events are read for these, and for the days of the steps."""
    from pathlib import Path

    from tracemill.plans import trace_queries as Q

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no tables here")
    seen, plain = spark.sparkContext.accumulator(0), Q.table

    def counted(spark, sf_dir, name):
        rows = plain(spark, sf_dir, name)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(count, rows.schema)

    monkeypatch.setattr(Q, "table", counted)
    assert Q.comparison_lines(spark, folder).count() > 0
    assert seen.value <= 6 * plain(spark, folder, "events").count()
