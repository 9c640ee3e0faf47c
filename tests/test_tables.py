from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracemill.operators import grid as G
from tracemill.operators import metadata as M
from tracemill.operators import triton as R

ROWS = [("Alpha", "12.3%", "10"), ("beta", "x", "9"), ("gamma", None, "0"), ("Delta|", "5%", "abc"), ("e", "7", "-1.5e1")]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "name string, pct string, v string")


def names(df):
    return [r["name"] for r in df.collect()]


def test_search(rows):
    assert names(G.search(rows, "ALP")) == ["Alpha"]
    assert names(G.search(rows, "")) == [r[0] for r in ROWS]


@pytest.mark.parametrize(
    "condition, found",
    [(("name", "~", "ALPHA|bet"), ["Alpha", "beta"]), (("name", "~", "|"), []), (("name", "!~", "a"), ["e"]), (("v", ">=", "9"), ["Alpha", "beta"]), (("v", "<", "0"), ["e"]), (("v", "=", "0 x"), ["gamma"]), (("v", ">", "none"), [r[0] for r in ROWS]), (("pct", ">", "6"), ["Alpha", "e"]), (("name", "~", ""), [r[0] for r in ROWS])],
)
def test_filters(rows, condition, found):
    assert names(G.filtered(rows, [condition])) == found


def test_sorting(rows):
    assert names(G.sorted_rows(rows, "v")) == ["e", "gamma", "beta", "Alpha", "Delta|"]
    assert names(G.sorted_rows(rows, "v", False)) == ["Delta|", "Alpha", "beta", "gamma", "e"]


def test_sums(rows):
    got = G.sums(rows.withColumn("efficiency", F.col("v"))).first()
    assert (got["v"], got["pct"], got["name"], got["efficiency"]) == (4.0, None, None, None)


def test_shares(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0)], "k string, v double")
    assert {r["k"]: r["share"] for r in G.shares(df, "v").collect()} == {"a": 0.25, "b": 0.75}
    assert {r["k"]: r["share"] for r in G.shares(df, "v", ["k"]).collect()} == {"a": 1.0, "b": 1.0}


@pytest.fixture
def jobs(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("1", "u", "p", "", "f.json", None, "/a", None, t), ("2", "u", None, "x", None, "/z", "/b", None, t), ("3", "v", "q", None, None, None, None, "2", t + dt.timedelta(days=1)), ("4", "v", "gone", None, None, None, None, "9", t)]
    more = [r[:8] + (None, None, None, "done", "single") + r[8:] for r in rows]
    return spark.createDataFrame(more, "id string, user_id string, project_id string, label string, file_a_name string, gzip_a_path string, file_a_path string, source_job_a_id string, gzip_b_path string, file_b_path string, source_job_b_id string, status string, mode string, created_at timestamp")


@pytest.fixture
def projects(spark):
    return spark.createDataFrame([("p", "u", "P", True, None), ("q", "v", "Q", True, "hash")], "id string, user_id string, name string, is_public boolean, password_hash string")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_jobs(jobs, projects):
    assert ids(M.jobs_page(jobs, limit=2, offset=1)) == ["1", "2"]
    assert ids(M.jobs_page(jobs, M.NO_PROJECT)) == ["2"]
    assert M.job_total(jobs, "p").first()[0] == 1
    assert {r["id"]: r["label"] for r in M.labelled(jobs).collect()} == {"1": "f.json", "2": "x", "3": "3", "4": "4"}
    assert {r["id"]: r["path_a"] for r in M.with_paths(jobs).collect()} == {"1": "/a", "2": "/z", "3": "/z", "4": None}
    assert {r["id"]: r["may_read"] for r in M.accessible(jobs, projects, "w").collect()} == {"1": True, "2": False, "3": False, "4": False}
    assert [r["group_label"] for r in M.grouped(jobs, projects).collect()] == ["P", "Q", M.UNGROUPED, M.UNGROUPED]
    assert M.comparable(jobs, "1", "2", "u").first()[0] is True
    assert M.comparable(jobs, "1", "3", "u").first()[0] is False
    assert M.comparable(jobs, "1", "nine", "u").first()[0] is False


def test_recoverable(spark, jobs):
    now = F.lit(dt.datetime(2024, 1, 11, 12))
    assert ids(M.recoverable(jobs.withColumnRenamed("created_at", "deleted_at"), now)) == ["3"]
    assert M.next_offset(0, 50, 60) == 50 and M.next_offset(50, 50, 60) == 50 and M.previous_offset(20, 50) == 0


@pytest.mark.parametrize("limit", [10, 0])
def test_measured_first_match(spark, limit):
    rows = spark.createDataFrame([("triton_poi_1",), ("triton_x",), ("triton_poi_1",)], "kernel_name string")
    outputs = spark.createDataFrame([("step_0/kernel_0_triton_poi_10.py", 2, "a b 7GB/s"), ("k_triton_poi_1.py", 3, "a b 8GB/s"), ("k_triton_poi_1.py", 1, "error")], "code_key string, pos int, stdout string")
    once = R.join_measured(rows, R.measured(outputs), limit)
    again = R.join_measured(once, R.measured(outputs), limit)
    assert sorted(map(tuple, again.collect()), key=str) == [("triton_poi_1", 7.0), ("triton_poi_1", 7.0), ("triton_x", None)]


def test_places_of_all_rows(spark):
    values = [str((k * 37) % 90) for k in range(300)] + ["0", "-3", "", None, "text", "4 GB"] * 20
    rows = spark.createDataFrame(list(enumerate(values)), "id int, v string").repartition(7)
    for ascending in (True, False):
        wanted = [r["id"] for r in G.sorted_rows(rows, "v", ascending, ["id"]).collect()]
        got = sorted(G.placed_rows(rows, "v", ascending, ["id"]).collect(), key=lambda r: r["place"])
        assert [r["place"] for r in got] == list(range(1, len(values) + 1)) and [r["id"] for r in got] == wanted


def test_rows_without_a_key_are_dealt(spark):
    """Jobs of no project find nothing, and no task gets them all."""
    jobs = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 == 0, F.col("id") % 20).cast("string").alias("project_id"))
    groups = spark.createDataFrame([("0", "u", "P", True, None), (None, "u", "none", True, None), ("1", "u", "false", True, None)], "id string, user_id string, name string, is_public boolean, password_hash string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = M.with_projects(jobs, groups)
        assert found.columns[:2] == ["project_id", "id"]
        named = found.groupBy("project_id", "project_name").count().collect()
        assert sorted((r["project_id"] or "", r["project_name"] or "", r["count"]) for r in named) == [("", "", 3600), ("0", "P", 200), ("10", "", 200)]
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
