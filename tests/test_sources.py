"""Documents split by byte ranges, archives, database tables, the sweep of many steps, names matched at once, and files with a commit."""

from __future__ import annotations

import io
import json
import random
import sqlite3
import tarfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracemill.operators import grid as G
from tracemill.operators import metadata as M
from tracemill.operators import steps as S
from tracemill.operators import triton as R
from tracemill.sources import files, split_json, tables, traces


def events(n, seed=3):
    rng = random.Random(seed)
    names = ['k}{"[]\\', "plain", "é}ü ", 'q"uote\\\\', "\\", "a,b", "", "}" * 9]
    out = [{"name": rng.choice(names) + str(i), "cat": rng.choice(["kernel", "x", None]), "ts": i * 1.5, "dur": rng.choice([None, 2.0, 3]), "args": {"triton output code": 'return {"a": [1,2]} \\ \'}\'', "o": {"z": [{"y": [1, {"w": "}"}]}]}}} for i in range(n)]
    return out[:3] + [None] + out[3:]


DOCUMENTS = {
    "a.json": json.dumps({"schemaVersion": 1, "x": [{"traceEvents": [{"name": "no"}]}, [1, 2]], "s": "traceEvents", "traceEvents": events(60), "z": [1, {"traceEvents": [5]}], "m": {"a": 1, "b": [2]}}),
    "b c.json": json.dumps({"traceEvents": events(9)}, indent=2, ensure_ascii=False) + "\n \n",
    "empty.json": '{"traceEvents": [ ] }',
    "two.json": '{"traceEvents":[{"name":"old"}],"traceEvents":[{"name":"new"},{"name":"new2"}]}',
    "escaped.json": '{"trace\\u0045vents":[{"name":"uni"}]}',
    "long.json": json.dumps({"traceEvents": [{"name": "x" * 5000, "args": {"triton output code": "}" * 3000}}, {"name": "y"}]}),
}


@pytest.fixture
def narrow(spark):
    """Byte ranges of some hundred bytes."""
    names = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "700")
    spark.conf.set(names[1], "0")
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("chunk", [50, split_json.CHUNK])
def test_split_documents(spark, tmp_path, narrow, monkeypatch, chunk):
    monkeypatch.setattr(split_json.chunks, "__defaults__", (chunk,))
    for name, text in DOCUMENTS.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in DOCUMENTS]
    assert spark.read.option("lineSep", "}").text(paths).rdd.getNumPartitions() > 20
    wanted = sorted(map(str, traces.read_traces(spark, *paths).collect()))
    assert sorted(map(str, traces.read_large_traces(spark, *paths).collect())) == wanted and len(wanted) > 70


@pytest.mark.parametrize("text", ['{"x":[]}', '[{"traceEvents":[]}]', '{"traceEvents":[{"name":"a"}]', '{"traceEvents":[{"name":"a}]}', '{"traceEvents":null}', '{"a":{"traceEvents":[]}}', '{"traceEvents":[{"name":"a"}]}}'])
def test_no_trace_documents(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(traces.InvalidTrace):
        traces.read_large_traces(spark, str(tmp_path / "bad.json"))


@pytest.mark.parametrize("seed", range(4))
def test_elements_at_every_cut(seed):
    """Two ranges that meet at any brace give the document's elements."""
    text = json.dumps({"a": [1, {"b": "}"}], "traceEvents": events(4, seed), "c": {"d": []}}).encode()
    _, _, whole = split_json.walked(text, split_json.State())
    wanted = [text[a:b] for _, _, a, b in whole]
    assert [json.loads(x) for x in wanted] == events(4, seed)
    for cut in (i + 1 for i, c in enumerate(text) if c == ord("}")):
        found, state = {}, split_json.State()
        for part in (text[:cut], text[cut:]):
            for item in split_json.elements(iter([part] if part else []), state):
                if isinstance(item, split_json.State):
                    state = item
                else:
                    found[item[1]] = found.get(item[1], b"") + item[2]
        assert [found[k] for k in sorted(found)] == wanted
        odd, outside, within = split_json.change(text[:cut])
        before, _, _ = split_json.walked(text[:cut], split_json.State())
        assert (bool(odd), outside) == (before.inside, before.depth)


def archive(path, mode, members):
    with tarfile.open(path, mode) as out:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))


def test_archives(spark, tmp_path):
    text = DOCUMENTS["a.json"].encode()
    members = [("small.json", b'{"traceEvents": []}'), ("d/large.json", text), ("huge.txt", b"x" * 99999)]
    archive(tmp_path / "a b.tar", "w", members)
    archive(tmp_path / "z.tgz", "w:gz", members)
    (tmp_path / "plain.json").write_bytes(text)
    wanted = sorted(map(str, traces.read_traces(spark, str(tmp_path / "plain.json")).drop("trace_id").collect()))
    got = traces.read_trace_archives(spark, str(tmp_path / "a b.tar"), str(tmp_path / "z.tgz"))
    for name in ("a b", "z"):
        assert sorted(map(str, got.filter(F.col("trace_id") == name).drop("trace_id").collect())) == wanted
    for name, members in (("none.tar", []), ("bad.tar", [("x.json", b'{"traceEvents": [')])):
        archive(tmp_path / name, "w", members)
        with pytest.raises(traces.InvalidTrace):
            traces.ingest_traces(traces.read_trace_archives(spark, str(tmp_path / name)), str(tmp_path / "store"))


def test_database(spark, tmp_path):
    path = str(tmp_path / "my service.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE projects (id TEXT PRIMARY KEY, user_id TEXT, name TEXT, is_public INTEGER, created_at TEXT)")
    db.executemany("INSERT INTO projects VALUES (?, ?, ?, ?, ?)", [(str(i), str(i % 7), f"n{i}", i % 2, "2024-01-02T03:04:05" if i else "?") for i in range(1000)])
    db.execute("CREATE TABLE users (id TEXT, created_at TEXT)")
    db.commit()
    db.close()
    found = tables.read_database(spark, path, "projects", 300)
    assert found.count() == 1000 and found.rdd.getNumPartitions() == 4
    one = {r["id"]: r for r in found.collect()}
    assert one["0"]["created_at"] is None and one["3"]["created_at"].minute == 4 and one["3"]["is_public"] is True and one["3"]["password_hash"] is None
    some = tables.read_database(spark, path, "projects", 300, {"user_id": ["3", "4"], "name": ["n3", "n4", "n5"]})
    assert sorted(r["id"] for r in some.collect()) == ["3", "4"]
    # a frame used twice in a query, with filters on one use
    both = found.filter("user_id = '3'").select("id").join(found.select("id", "name"), "id")
    assert both.count() == sum(i % 7 == 3 for i in range(1000)) and found.select("id").unionByName(found.filter("id = '1'").select("id")).count() == 1001
    assert tables.read_database(spark, path, "users").count() == 0


def test_sweep_of_clustered_steps(spark):
    """Steps within a hundredth of a trace's span: the largest range has at most three times the rows of the middle one."""
    n = 40_000
    steps = spark.range(n).select(F.lit("t").alias("trace_id"), F.col("id").cast("int").alias("step"), F.col("id").alias("ord"), (F.col("id") * 10.0).alias("start"), (F.col("id") * 10.0 + 4).alias("end"))
    steps = steps.withColumn("nxt", F.col("start") + 10)
    spread = spark.range(2 * n).select(F.lit("t").alias("trace_id"), F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, F.col("id") * 5.0 + F.col("id") % 3 * 4).otherwise(F.col("id") * 1000.0).alias("ts"))
    got = S.assigned(spread, steps, 10)
    wanted = spread.withColumn("step", F.floor(F.col("ts") / 10).cast("int")).filter("ts < 10 * 40000 AND ts - step * 10 <= 4")
    assert got.select("ord", "step").exceptAll(wanted.select("ord", "step")).isEmpty() and got.count() == wanted.count()
    sizes = sorted(r["count"] for r in spread.select("ts").unionByName(steps.select(F.col("start").alias("ts"))).repartitionByRange(8, "ts").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_sweep_keeps_columns_and_ties(spark):
    steps = spark.createDataFrame([("a", 1, 0, 0.0, 9.0), ("a", 2, 1, 5.0, 6.0), ("a", 3, 2, 5.0, 8.0), ("b", 4, 0, 5.0, 5.0)], "trace_id string, step int, ord long, start double, end double")
    rows = [("a", 0, 4.0, "x"), ("a", 1, 5.0, "x"), ("a", 2, 8.0, "x"), ("a", 3, 8.5, "x"), ("a", 4, -1.0, "x"), ("b", 0, 4.0, "x"), ("b", 1, 5.0, "x"), ("c", 1, 5.0, "x"), ("a", 9, None, "x")]
    found = S.swept(spark.createDataFrame(rows, "trace_id string, ord long, ts double, `at.x` string"), steps)
    assert found.columns == ["trace_id", "ord", "ts", "at.x", "step"]
    assert sorted((r["trace_id"], r["ord"], r["step"]) for r in found.collect()) == [("a", 0, 1), ("a", 1, 3), ("a", 2, 3), ("b", 1, 4)]


def by_hand(names, keys):
    return {n: min(((p, e) for k, p, e in keys if e is not None and k is not None and n in k), default=(0, None))[1] for n in names if n is not None}


@pytest.mark.parametrize("limit", [R.MATCHER_BYTES, 0])
def test_names_in_keys(spark, limit):
    rng = random.Random(4)
    names = ["".join(rng.choice("abé_") for _ in range(rng.randrange(1, 5))) for _ in range(80)] + ["never there", None]
    keys = [("".join(rng.choice("abé_/") for _ in range(rng.randrange(0, 30))), i, rng.choice([None, 1.5, 2.5])) for i in range(400)] + [(None, 1000, 1.0)]
    rows = spark.createDataFrame([(n,) for n in names], "kernel_name string")
    found = R.join_measured(rows, spark.createDataFrame(keys, "code_key string, pos int, eff double").repartition(5), limit)
    assert {r["kernel_name"]: r["local_efficiency"] for r in found.collect() if r["kernel_name"] is not None} == by_hand(names, keys) and found.count() == len(names)


def test_empty_name_is_in_every_key(spark):
    rows = spark.createDataFrame([("",)], "kernel_name string")
    keys = spark.createDataFrame([("b", 2, 2.0), ("a", 1, 1.0)], "code_key string, pos int, eff double")
    assert R.join_measured(rows, keys).first()["local_efficiency"] == 1.0


def test_matching_is_one_pass_over_keys():
    """Ten times the names take little more time: an automaton's work is keys and hits."""
    import ahocorasick

    rng = random.Random(5)
    text = ["".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(3000)]
    took = []
    for n in (300, 3000):
        automaton = ahocorasick.Automaton()
        for k in range(n):
            automaton.add_word("".join(rng.choice("abcdefgh") for _ in range(12)), k)
        automaton.make_automaton()
        begin = time.perf_counter()
        for t in text:
            for _ in automaton.iter(t):
                pass
        took.append(time.perf_counter() - begin)
    assert took[1] < 5 * took[0]


def test_measured_is_parsed_once(spark):
    outputs = spark.createDataFrame([("k", 1, "a b 7GB/s")], "code_key string, pos int, stdout string")
    plan = R.measured(outputs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2


def test_many_files(spark, tmp_path):
    rows = spark.range(10_000).select(F.concat(F.lit("step_"), F.col("id") % 50, F.lit("/kernel_"), "id", F.lit(".py")).alias("file"), F.concat(F.lit("code "), "id").alias("text"))
    files.write_files(rows, str(tmp_path / "out"))
    there = list((tmp_path / "out").rglob("*.py"))
    assert len(there) == 10_000 and all(p.read_text() == f"code {p.stem[7:]}" for p in there[::97])
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]
    # a step's folder is replaced as a whole, others stay
    files.write_files(rows.filter("id = 3"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out/step_3").iterdir())) == 1 and len(list((tmp_path / "out/step_4").iterdir())) == 200


def test_nothing_is_seen_after_a_failure(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("f"), "id").alias("file"), F.when(F.col("id") < 99, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("broken"))).alias("text"))
    with pytest.raises(Exception, match="broken"):
        files.write_files(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    for file in ("../x", "/x"):
        with pytest.raises(Exception, match="below the target"):
            files.write_files(spark.createDataFrame([(file, "a")], "file string, text string"), str(tmp_path / "out"))


def test_folders_are_not_replaced_by_files(spark, tmp_path):
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine/a").write_text("keep")
    with pytest.raises(Exception, match="folder"):
        files.write_files(spark.createDataFrame([("mine", "a")], "file string, text string"), str(tmp_path))
    with pytest.raises(IsADirectoryError):
        tables.write_table(spark.range(1), str(tmp_path / "mine"))
    assert (tmp_path / "mine/a").read_text() == "keep"
    (tmp_path / "t.csv").write_text("old")
    tables.write_table(spark.range(1), str(tmp_path / "t.csv"))
    assert (tmp_path / "t.csv").read_bytes() == b"id\r\n0\r\n" and not list(tmp_path.glob("t.csv.*"))


def test_a_failed_commit_is_undone(tmp_path):
    writer = files.NamedFilesWriter(str(tmp_path / "out"))
    (tmp_path / "out/a").mkdir(parents=True)
    (tmp_path / "out/a/x").write_text("old")
    done = writer.write(iter([{"file": "a/x", "text": b"new"}, {"file": "b", "text": b"1"}, {"file": "b", "text": b"2"}]))
    Path(done.folder, "b").unlink()
    with pytest.raises(Exception):
        writer.commit([done])
    assert (tmp_path / "out/a/x").read_text() == "old" and not (tmp_path / "out/b").exists()
    writer.abort([done])
    again = files.NamedFilesWriter(str(tmp_path / "out"))
    again.commit([again.write(iter([{"file": "b", "text": b"1"}, {"file": "b", "text": b"2"}])), None])
    assert (tmp_path / "out/b").read_text() == "12" and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "b"]


def test_pages_of_all_rows(spark):
    rows = spark.range(237).select(F.col("id").cast("string").alias("id"), (F.col("id") % 9).alias("created_at")).repartition(5)
    got = {r["id"]: r for r in M.paged(M.newest_first(rows), 50).collect()}
    order = sorted(range(237), key=lambda i: (-(i % 9), str(i)))
    assert [got[str(i)]["place"] for i in order] == list(range(1, 238))
    last, first = got[str(order[-1])], got[str(order[0])]
    assert (first["offset"], first["next_offset"], first["previous_offset"]) == (0, 50, 0)
    assert (last["offset"], last["next_offset"], last["previous_offset"]) == (200, M.next_offset(200, 50, 237), M.previous_offset(200, 50))
    assert G.placed(rows.limit(0)).count() == 0


def test_database_in_several_files(spark, tmp_path):
    """Each task writes a file of its own; all are read, and only the columns that are named."""
    from tracemill.plans.trace_queries import as_database

    written = as_database(spark.range(1000).repartition(4).select(F.col("id").cast("string").alias("id"), F.lit("n").alias("name")), str(tmp_path / "db"), "projects")
    assert len(set(written)) == 4
    found = tables.read_database(spark, written, "projects", 100, columns=["id", "name"])
    assert found.columns == ["id", "name"] and found.rdd.getNumPartitions() >= 12
    assert sorted(int(r["id"]) for r in found.collect()) == list(range(1000))


def test_paths_among_all_jobs(spark):
    jobs = spark.createDataFrame([("1", "/a", None, None), ("2", None, None, "1"), ("3", None, "/g", None), ("4", None, None, None)], "id string, file_a_path string, gzip_a_path string, source_job_a_id string")
    some = M.with_paths(jobs.filter("id > '1'"), jobs, "a")
    assert {r["id"]: r["path_a"] for r in some.collect()} == {"2": "/a", "3": "/g", "4": None}


def test_documents_are_bounded(spark, tmp_path):
    """Documents of at most so many events, whole, each written and read by one task; archives of them are streamed."""
    from tracemill.plans import trace_queries as Q

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no tables here")
    n = Q.trace_events(spark, folder).count()
    for documents in (Q.write_documents(spark, folder, 70), Q.write_ordered_documents(spark, folder, 70)):
        sizes = [r["count"] for r in traces.read_traces(spark, documents).groupBy("trace_id").count().collect()]
        assert sum(sizes) == n and max(sizes) <= 140 and len(sizes) >= n // 140
    paths = traces.trace_files(spark, Q.write_documents(spark, folder, 70))
    packed = next(p for p in paths if p.endswith(".gz"))
    import pyarrow as pa

    pieces = [b for b in Q._archived(iter([pa.RecordBatch.from_pydict({"path": [packed]})]))]
    data = b"".join(x for b in pieces for x in b.column("text").to_pylist())
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as archive:
        assert archive.getnames() == ["first.json", "run/trace.json"]
        assert len(json.load(archive.extractfile("run/trace.json"))["traceEvents"]) <= 70
