from __future__ import annotations

import bisect
import gzip
import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from tracemill.__main__ import main
from tracemill.analysis import analyse, comparison_report, single_report, write_comparison, write_single
from tracemill.functions import formatting as N
from tracemill.functions import text as T
from tracemill.operators import averages as A
from tracemill.operators import compare as C
from tracemill.operators import facts as X
from tracemill.operators import families as K
from tracemill.operators import steps as S
from tracemill.operators import triton
from tracemill.schema import EVENTS
from tracemill.sources import tables, traces

from .conftest import BASIC


def frame(spark, rows):
    """Events from (name, cat, ts, dur[, args]) or with a leading trace id."""
    return traces.normalized(spark.createDataFrame([(r[0], k, *r[1:], *[None] * (6 - len(r))) for k, r in enumerate(rows)], EVENTS))


def basic(spark, trace_file):
    return analyse(traces.read_traces(spark, trace_file))


def by_name(df, *columns):
    return {r["name"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_golden(spark, trace_file):
    one = basic(spark, trace_file)
    stats = {r["step"]: r for r in one.step_stats.collect()}
    assert tuple(stats[7][m] for m in A.METRICS) == (40, 2, 13.5, 1, 9, 1, 0.6, 1, 1.5)
    assert tuple(stats[8][m] for m in A.METRICS) == (40, 0, 0, 0, 0, 0, 0, 0, 0)
    assert tuple(stats[9][m] for m in A.METRICS) == (40, 1, 3, 1, 3, 0, 0, 0, 0)
    mean = A.step_mean(one.step_stats).first()
    assert [mean[m] for m in A.METRICS] == pytest.approx([40, 1, 5.5, 2 / 3, 4, 1 / 3, 0.2, 1 / 3, 0.5])
    assert [r["name"] for r in A.ordered(one.kernels).collect()] == ["triton_poi_fused_add_3", "sm80_xmma_gemm_f16", "triton_red_fused_sum_1"]
    assert by_name(one.kernels, "avg_count", "avg_dur_ms")["sm80_xmma_gemm_f16"] == pytest.approx((1 / 3, 2))
    families = {r["family"]: r["avg_dur_ms"] for r in one.families.collect()}
    assert families == pytest.approx({"triton_pointwise": 3, "gemm": 2, "triton_reduce": 1, "other": 0})
    assert by_name(one.triton, "avg_io_gb", "avg_io_eff")["triton_poi_fused_add_3"] == pytest.approx((0.75, 512.5 / 3))
    assert by_name(one.averages(S.COMM), "avg_count", "avg_dur_ms") == {"ncclAllGather_ring": pytest.approx((1 / 3, 0.5))}
    top = A.top_kernels(one.kernels, 2).orderBy("rank").collect()
    assert [(r["rank"], r["family"]) for r in top] == [(1, "triton_pointwise"), (2, "gemm")]
    assert sum(r["dur_pct"] for r in A.top_kernels(one.kernels, 99).collect()) == pytest.approx(100)


STEPS = [("t", "ProfilerStep#0", "user_annotation", 0.0, 100.0), ("t", "ProfilerStep#1", "user_annotation", 100.0, 100.0), ("t", "ProfilerStep#2", "user_annotation", 150.0, 10.0), ("t", "ProfilerStep#3", "user_annotation", 300.0, 100.0), ("t", "ProfilerStep#4", "user_annotation", 300.0, 50.0)]


@pytest.mark.parametrize("limit", [100, 0])
def test_step_edges(spark, limit):
    wanted = {-1: None, 0: 0, 100: 1, 155: 2, 170: None, 320: 4, 350: 4, 380: None}
    events = frame(spark, STEPS + [("t", f"k{ts}", "kernel", float(ts), 1.0) for ts in wanted])
    got = by_name(S.assigned(S.routed(events).filter("kind = 'kernel'"), S.steps(events), limit), "step")
    assert got == {f"k{ts}": (step,) for ts, step in wanted.items() if step is not None}


def test_repeated_and_unreadable_steps(spark):
    events = frame(spark, [("t", "ProfilerStep#1", "user_annotation", 0.0, 5.0), ("t", "ProfilerStep#x", "user_annotation", 0.0, 5.0), ("t", "ProfilerStep#1", "user_annotation", 50.0, 5.0), ("t", "ProfilerStep#7", "kernel", 52.0, 1.0), ("t", "late", "kernel", None, 1.0)])
    assert [(r["step"], r["ord"], r["start"]) for r in S.steps(events).collect()] == [(1, 0, 50.0)]
    assert [r["name"] for r in S.assigned(S.routed(events).filter("kind = 'kernel'"), S.steps(events)).collect()] == ["ProfilerStep#7"]
    assert [r["ord"] for r in traces.strict_problems(events).collect()] == [1]


@pytest.mark.parametrize("seed", range(3))
def test_steps_against_bisect(spark, seed):
    rng = random.Random(seed)
    rows, wanted = [], {}
    for trace in ("a", "b"):
        starts = sorted((rng.randrange(300), k) for k in range(12))
        ends = {k: s + rng.randrange(60) for s, k in starts}
        rows += [(trace, f"ProfilerStep#{k}", "user_annotation", float(s), float(ends[k] - s)) for s, k in starts]
        for i in range(150):
            ts = rng.randrange(-10, 400)
            rows.append((trace, f"{trace}{i}", "kernel", float(ts), 1.0))
            at = bisect.bisect_right([s for s, _ in starts], ts) - 1
            if at >= 0 and ts <= ends[starts[at][1]]:
                wanted[f"{trace}{i}"] = (starts[at][1],)
    events = frame(spark, rows)
    kernels, steps = S.routed(events).filter("kind = 'kernel'"), S.steps(events)
    assert by_name(S.assigned(kernels, steps), "step") == by_name(S.assigned(kernels, steps, 0), "step") == wanted


def test_means_are_zero_filled_and_order_free(spark):
    rng = random.Random(1)
    rows = [("t", f"ProfilerStep#{k}", "user_annotation", 100.0 * k, 99.0) for k in range(5)]
    events = [("t", f"k{rng.randrange(9)}", "kernel", rng.randrange(500) + 0.0, rng.randrange(9999) / 1000) for _ in range(200)]
    dense = {}
    for _, name, _, ts, dur in events:
        if ts % 100 <= 99:
            dense[name] = dense.get(name, 0) + dur / 1000
    found = analyse(frame(spark, rows + events)), analyse(frame(spark, (rows + events)[::-1]))
    first, second = (by_name(a.kernels, "avg_count", "avg_dur_ms") for a in found)
    assert first.keys() == second.keys() and all(first[k] == pytest.approx(second[k], rel=1e-12) for k in first)
    assert {k: v[1] for k, v in first.items()} == pytest.approx({k: v / 5 for k, v in dense.items()})


@pytest.mark.parametrize(
    "name, family",
    [("triton_red_fused_1", "triton_reduce"), ("triton_per_x", "triton_reduce"), ("triton_poi_fused_1", "triton_pointwise"), ("triton_tem_x", "triton_pointwise"), ("triton_mm_2", "triton_mm"), ("TRITON_foo_1", "triton_foo"), ("triton_", "triton_"), ("TCDP_RING_ALLREDUCE_x", "collective"), ("ncclKernel_reduce_sum", "collective"), ("all_reduce", "all_reduce"), ("gemm_softmax", "gemm"), ("void mlu::PoolingForwardKernel<float, long>", "PoolingForwardKernel"), ("random_kernel", "random_kernel"), ("void (anonymous namespace)::k<3>", "other"), ("", "other"), ("at::native::vectorized_Copy_kernel(int)", "memory"), (" naïve::Größe (x)", "naïve::Größe")],
)
def test_families(spark, name, family):
    assert spark.createDataFrame([(name,)], "name string").select(K.family(F.col("name"))).first()[0] == family


def test_types_overlap(spark):
    events = frame(spark, STEPS[:1] + [("t", "triton_red_gemm", "kernel", 1.0, 1000.0), ("t", "GEMM_CUDA", "kernel", 1.0, 1000.0), ("t", "foo", "kernel", 1.0, 1000.0, (None, None, None, None, "y")), ("t", "random_kernel", "kernel", 1.0, 1000.0)])
    got = {r["type"]: (r["count"], r["dur_ms"]) for r in X.type_facts(X.placed_events(events, S.steps(events)), ["red", "gemm", "", "CUDA"]).collect()}
    assert got == {"triton": (1, 1.0), "red": (1, 1.0), "gemm": (2, 2.0), "collective": (1, 1.0), "random_kernel": (1, 1.0)}


def test_readers(spark, trace_file, tmp_path):
    text = open(trace_file).read()
    with gzip.open(tmp_path / "z.json.gz", "wt") as f:
        f.write(text)
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as archive:
        for name, data in (("small.json", b'{"traceEvents": []}'), ("d/large.json", text.encode()), ("huge.txt", b"x" * 99999)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    plain = traces.read_traces(spark, trace_file, str(tmp_path / "z.json.gz"))
    assert {r["trace_id"]: r["count"] for r in plain.groupBy("trace_id").count().collect()} == {"basic": 8, "z": 8}
    archived = traces.read_trace_archives(spark, str(tmp_path / "a.tar.gz"))
    assert archived.drop("trace_id").exceptAll(plain.filter("trace_id = 'z'").drop("trace_id")).isEmpty() and archived.count() == 8
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, BASIC)))
    assert traces.read_event_lines(spark, str(tmp_path / "lines.json")).count() == 8
    stored = traces.ingest_traces(plain, str(tmp_path / "events"))
    assert stored.count() == 16 and stored.columns == EVENTS.names
    assert "PartitionFilters: [isnotnull(trace_id" in stored.filter("trace_id = 'z'")._jdf.queryExecution().toString()


@pytest.mark.parametrize("text", ["[]", "{}", '{"traceEvents": 3}'])
def test_invalid_traces(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(traces.InvalidTrace):
        traces.ingest_traces(traces.read_traces(spark, str(tmp_path / "bad.json")), str(tmp_path / "out"))


def test_strict_ingest(spark, tmp_path):
    (tmp_path / "bad.json").write_text(json.dumps({"traceEvents": [{"name": "ProfilerStep#abc", "cat": "user_annotation", "ts": 1}]}))
    events = traces.read_traces(spark, str(tmp_path / "bad.json"))
    assert analyse(traces.ingest_traces(events, str(tmp_path / "out"))).steps.count() == 0
    with pytest.raises(traces.InvalidTrace):
        traces.ingest_traces(events, str(tmp_path / "out"), strict=True)


def test_empty_trace(spark, tmp_path):
    (tmp_path / "none.json").write_text('{"traceEvents": []}')
    one = analyse(traces.read_traces(spark, str(tmp_path / "none.json")))
    assert "(0 steps)" in single_report(one) and one.kernels.count() == 0
    assert A.mean_or_zero(one.step_stats).first()["kernels"] == 0.0


@pytest.mark.parametrize("value, shown", [(None, ""), (123.456, "123"), (0.001234, "0.00123"), (1234567, "1230000"), (0, "0"), (-0.0, "-0"), (1.125, "1.12"), (2.675, "2.67"), (100.0, "100")])
def test_three_figures(spark, value, shown):
    assert N.three_figures(value) == shown
    assert spark.createDataFrame([(None if value is None else float(value),)], "v double").select(N.three_figures_column(F.col("v"))).first()[0] == shown


@pytest.mark.parametrize("a, b, shown", [(100, 120, "+20.0%"), (100, 80, "-20.0%"), (100, 100, "+0.0%"), (0, 100, "")])
def test_percent_change(spark, a, b, shown):
    row = spark.createDataFrame([(float(a), float(b))], "a double, b double").select(C.pct_change(F.col("a"), F.col("b"))).first()
    assert N.signed_percent(row[0]) == shown


@pytest.mark.parametrize("value, shown", [(None, ""), (3.0, "3"), (2.5, "2.5"), (1.23456, "1.235"), (2.0001, "2")])
def test_plain_sum(value, shown):
    assert N.plain_sum(value) == shown


def test_text_functions(spark):
    row = spark.createDataFrame([("x" * 60, "a\nb\r", "ran in 3 12.345GB/s", "2024-01-02T03:04:05", " 12.3% ", "-.5e1x", "+1.5%")], "n string, t string, m string, d string, p string, e string, c string")
    got = row.select(T.shortened(F.col("n")), T.one_line(F.col("t")), T.measured_gb_s(F.col("m")), T.first_gb_s(F.col("m")), T.short_date(F.col("d")), T.parse_float(F.col("p")), T.parse_float(F.col("e")), T.change_class("pct_change", F.col("c")), T.code_file_name(F.lit(3), F.lit("a/b c")), T.console_line(F.lit("=== x"))).first()
    assert tuple(got) == ("x" * 52 + "...", "a\\nb", 12.35, 12.345, "2024-01-02 03:04", 12.3, -5.0, "worse", "kernel_3_a_b_c.py", "header")


def csv_of(file):
    return file.read_bytes()


def test_csv_dialect(spark, tmp_path):
    rows = spark.createDataFrame([("kernel_a", 10.0, 5.5), ('k<a, "b">\nc', 20.0, 3.2)], "name string, avg_count double, avg_dur_ms double")
    from tracemill.present import ops_table

    tables.write_table(ops_table(rows), str(tmp_path / "x.csv"))
    assert csv_of(tmp_path / "x.csv") == b'op_name,avg_count,avg_dur_ms\r\nkernel_a,10,5.5\r\n"k<a, ""b"">\nc",20,3.2\r\n'
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "x.csv")).collect()] == [("kernel_a", "10", "5.5"), ('k<a, "b">\nc', "20", "3.2")]
    assert tables.read_table(spark, str(tmp_path / "none.csv")).columns == []


def test_files_of_one_trace(spark, trace_file, tmp_path):
    one = basic(spark, trace_file).stored(str(tmp_path / "facts"))
    write_single(one, str(tmp_path / "out"), step_tables=True, step_code=True)
    assert csv_of(tmp_path / "out/all_kernels_avg.csv").decode().split("\r\n")[:2] == ["kernel_name,family,avg_count,count_pct,avg_dur_ms,dur_pct,avg_us_per_call", "triton_poi_fused_add_3,triton_pointwise,0.333,33.3%,3,50.0%,9000"]
    assert csv_of(tmp_path / "out/kernel_types_avg.csv").decode().split("\r\n")[-2] == "other,0,0.0%,0,0.0%"
    file = "step_7_triton_codes/kernel_0_triton_poi_fused_add_3.py"
    wanted = f'kernel_name,dur(ms),total io(GB),IO efficiency(GB/s),tiling config,triton_code_file\r\ntriton_poi_fused_add_3,9,2.25,512,"XBLOCK=64,\\nnum_warps=4",{file}\r\n'
    assert csv_of(tmp_path / "out/step_7_triton_kernels.csv").decode() == wanted
    assert (tmp_path / "out" / file).read_text() == 'code, "y"\n'
    found = [r["name"] for r in tables.result_files(spark, str(tmp_path / "out")).collect()]
    assert found == [*tables.RESULTS[:5], "step_7_triton_kernels.csv"]
    report = single_report(one, label="run")
    assert "=== Per-Step Summary (3 steps) — run ===" in report and "1    triton_pointwise" in report
    for _ in range(2):  # done again it gives the same
        outputs = spark.createDataFrame([(file, 0, "ran in 3 77.125GB/s")], "code_key string, pos int, stdout string")
        assert tables.add_efficiency(spark, str(tmp_path / "out"), triton.measured(outputs)) == ["triton_kernels_avg.csv", "step_7_triton_kernels.csv"]
        assert csv_of(tmp_path / "out/step_7_triton_kernels.csv").decode() == wanted.replace("code_file\r", "code_file,local efficiency\r").replace(f"{file}\r", f"{file},77.12\r")
        avg = csv_of(tmp_path / "out/triton_kernels_avg.csv").decode().split("\r\n")
        assert avg[0].endswith(",local efficiency") and avg[1].endswith(",77.12") and avg[2].endswith(",")


def test_traces_of_equal_names(spark, trace_file, tmp_path):
    for folder, dur in (("before", 10), ("after run", 20)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "my run.json").write_text(json.dumps({"traceEvents": [BASIC[1], {"name": "k", "cat": "kernel", "ts": 5040001, "dur": dur}]}))
    files = [str(tmp_path / f / "my run.json") for f in ("before", "after run")]
    events = traces.read_traces(spark, *files, files[0])
    assert {r["trace_id"]: r["n"] for r in events.groupBy("trace_id").agg(F.count("*").alias("n")).collect()} == {"before/my run": 2, "after run/my run": 2}
    both = analyse(events)
    assert {r["avg_dur_ms_A"] * 1000 for r in C.compare_names(both.kernels, "before/my run", "after run/my run").collect()} == {10}
    main([*files, "-o", str(tmp_path / "out")])
    assert not [p for p in (tmp_path / "out").iterdir() if "facts" in p.name]
    assert csv_of(tmp_path / "out/all_kernels_cmp.csv").decode().split("\r\n")[1] == "k,0.01,0.02,0.01,+100.0%,1,1"
    assert traces.trace_ids(["a/x.json", "a/x.json.gz", "b/y.json"]) == {"a/x.json": "a/x.json", "a/x.json.gz": "a/x.json.gz", "b/y.json": "y"}


def test_store_keeps_other_traces(spark, trace_file, tmp_path):
    own = traces.read_traces(spark, trace_file)
    for name in ("x", "y", "y"):
        stored = traces.ingest_traces(own.withColumn("trace_id", F.lit(name)), str(tmp_path / "store"))
    assert {r["trace_id"]: r["count"] for r in stored.groupBy("trace_id").count().collect()} == {"x": 8, "y": 8}


def test_family_filters_stay_above_the_aggregation(spark):
    from tracemill.plans.trace_queries import QUERIES

    for name in ("top_kernels", "family_breakdown", "cmp_families"):
        plan = QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "cutlass" not in plan[plan.rindex("Aggregate"):], name


def test_trace_without_steps_has_other(spark):
    one = analyse(frame(spark, [("t", "k", "kernel", 0.0, 1.0)]))
    assert [tuple(r) for r in one.families.collect()] == [("t", "other", 0.0, 0.0)]


def test_hundredths(spark):
    rng = random.Random(4)
    values = [2.675, 1.005, 0.125, 0.375, 350.265, 1e-9, 0.0, 12.345, 1e17, -2.675, 0.005, 0.015, float(2**52), 3e15 + 0.5] + [rng.randrange(10**6) / 1000 for _ in range(500)] + [rng.random() * 10 ** rng.randrange(-4, 12) for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(T.hundredths(F.col("v"))).collect()]
    assert got == [float(f"{v:.2f}") for v in values]


def test_metadata_tables(spark, tmp_path):
    (tmp_path / "users.csv").write_text("id,extra\nu1,x\n")
    spark.createDataFrame([("p1", "u1", "n")], "id string, user_id string, name string").write.parquet(str(tmp_path / "projects.parquet"))
    assert [r["id"] for r in tables.read_metadata(spark, str(tmp_path), "users").collect()] == ["u1"]
    got = tables.read_metadata(spark, str(tmp_path), "projects")
    assert got.columns[:3] == ["id", "user_id", "name"] and got.first()["is_public"] is None


def test_exported_view(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b,c", "2"), ("d", "3")], "name string, v string")
    tables.export_view(rows, [("v", "<", "3")], "", str(tmp_path / "view.csv"))
    assert csv_of(tmp_path / "view.csv") == b'name,v\r\na,1\r\n"b,c",2\r\n'


def test_comparing_a_trace_with_itself(spark, trace_file, tmp_path):
    events = traces.read_traces(spark, trace_file)
    both = analyse(events.withColumn("trace_id", F.lit("A")).unionByName(events.withColumn("trace_id", F.lit("B"))))
    assert {(r["delta_dur_ms"], r["pct_change"]) for r in C.compare_names(both.kernels, "A", "B").collect()} == {(0.0, 0.0)}
    families = C.compare_families(both.families, "A", "B").orderBy("sort_rank").collect()
    assert families[-1]["family"] == "other" and sum(r["dur_pct_A"] for r in families) == pytest.approx(100)
    write_comparison(both, "A", "B", str(tmp_path))
    assert csv_of(tmp_path / "triton_kernels_cmp.csv").decode().split("\r\n")[1] == "triton_poi_fused_add_3,3,3,0,+0.0%,0.333,0.333,0.75,0.75"
    assert "=== Avg Comparison (A vs B) ===" in comparison_report(both, "A", "B")


def test_result_files(spark, tmp_path):
    for name in ("step_10_triton_kernels.csv", "step_2_triton_kernels.csv", "cncl_ops_avg.csv", "all_kernels_avg.csv", "notes.txt"):
        (tmp_path / name).write_text("a\n1\n")
    assert [r["name"] for r in tables.result_files(spark, str(tmp_path)).collect()] == ["all_kernels_avg.csv", "cncl_ops_avg.csv", "step_10_triton_kernels.csv", "step_2_triton_kernels.csv"]


def test_command_calls_files_by_their_names(spark, trace_file, tmp_path, capsys):
    (tmp_path / "other.json").write_text(open(trace_file).read())
    main([trace_file, str(tmp_path / "other.json"), "-o", str(tmp_path / "out")])
    shown = capsys.readouterr().out
    assert "— basic.json ===" in shown and "=== Avg Comparison (basic.json vs other.json) ===" in shown
    main([trace_file, "-o", str(tmp_path / "out"), "-s", "-c"])
    assert "=== Top 10 Compute Hotspot Kernels ===" in capsys.readouterr().out and (tmp_path / "out/step_7_triton_codes").is_dir()
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".facts") or p.name.startswith(".staged")]
