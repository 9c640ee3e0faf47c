"""Rows of Triton calls by step, and measured throughput joined to result rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_file_name, measured_gb_s, one_line

#: Different kernel names of so many bytes in all are matched by one automaton, which every task holds.
MATCHER_BYTES = 16 * 2**20


def step_rows(calls: DataFrame) -> DataFrame:
    """Calls that have code, numbered from 0 in their step in the order of the trace: trace_id, step, idx, kernel_name, dur_ms, io_gb, io_eff, tiling, code_file."""
    coded = calls.filter(F.col("code").isNotNull())
    idx = F.row_number().over(Window.partitionBy("trace_id", "step").orderBy("ord")) - 1
    return coded.withColumn("idx", idx).select(
        "trace_id", "step", "idx", "kernel_name", "dur_ms", "io_gb", "io_eff", one_line(F.col("tiling")).alias("tiling"), F.concat(F.lit("step_"), "step", F.lit("_triton_codes/"), code_file_name(F.col("idx"), F.col("kernel_name"))).alias("code_file"), "code"
    )


def measured(measurements: DataFrame) -> DataFrame:
    """code_key, pos, eff from rows (code_key, pos, stdout) of programs' output; eff is null where none is found."""
    return measurements.select("code_key", "pos", measured_gb_s(F.col("stdout")).alias("eff"))


def contained_in(names: DataFrame, keys: DataFrame) -> DataFrame:
    """kernel_name, eff: of ``keys`` (code_key, pos, eff) whose key contains the name, the eff of least pos. Few names: at most MATCHER_BYTES of text.

    All names are one automaton (Aho and Corasick), which a task builds once; a key is read once, whatever the number of names.
    A task passes on a row a name at most.
    """
    shipped = keys.sparkSession.sparkContext.broadcast([r[0] for r in names.collect()])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in shipped.value:
            if name:
                automaton.add_word(name, name)
        automaton.make_automaton()
        best: dict[str, tuple] = {}
        for batch in batches:
            for key, pos, eff in zip(*(c.to_pylist() for c in batch.columns)):
                # the empty name is in every key
                found = {name for _, name in automaton.iter(key)} if len(automaton) else set()
                for name in found | ({""} if "" in shipped.value else set()):
                    if name not in best or pos < best[name][0]:
                        best[name] = pos, eff
        yield pa.RecordBatch.from_arrays([pa.array(best, pa.string()), pa.array([v[0] for v in best.values()], pa.int64()), pa.array([v[1] for v in best.values()], pa.float64())], names=["kernel_name", "pos", "eff"])

    hits = keys.select("code_key", F.col("pos").cast("long"), F.col("eff").cast("double")).mapInArrow(match, "kernel_name string, pos long, eff double")
    return hits.groupBy("kernel_name").agg(F.min_by("eff", "pos").alias("eff"))


def join_measured(rows: DataFrame, measurements: DataFrame, matcher_bytes: int = MATCHER_BYTES) -> DataFrame:
    """``rows`` (with kernel_name) and local_efficiency: of the measurements whose key contains the kernel's name, the first that has a value.

    Names are matched once each; the same result whether run once or again. Names of more than ``matcher_bytes`` in all
    are joined by equality with the keys' substrings of their lengths instead.
    """
    known = measurements.filter("eff IS NOT NULL AND code_key IS NOT NULL").select("code_key", "pos", "eff")
    names = rows.filter("kernel_name IS NOT NULL").select("kernel_name").distinct()
    if names.agg(F.coalesce(F.sum(F.octet_length("kernel_name") + 1), F.lit(0))).first()[0] <= matcher_bytes:
        first = contained_in(names, known)
    else:
        lengths = sorted(r["n"] for r in names.select(F.length("kernel_name").alias("n")).distinct().collect())
        parts = known.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).filter(F.length("code_key") >= F.col("n"))
        parts = parts.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("code_key") - F.col("n") + 1))).withColumn("kernel_name", F.col("code_key").substr(F.col("i"), F.col("n")))
        first = names.join(parts.select("kernel_name", "pos", "eff"), "kernel_name").groupBy("kernel_name").agg(F.min_by("eff", "pos").alias("eff"))
    return rows.drop("local_efficiency").join(first.withColumnRenamed("eff", "local_efficiency"), "kernel_name", "left")
