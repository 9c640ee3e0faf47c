"""One trace, or two side by side: from events to all results, files and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import present
from .operators import averages as A
from .operators import compare as C
from .operators import facts as X
from .operators import steps as S
from .operators import triton as R
from .sources import tables


@dataclass(frozen=True)
class Analysis:
    """Lazy frames of any number of traces. ``facts`` is the only large shuffle: write and reread it (``stored``) to share it between results."""

    traces: DataFrame
    steps: DataFrame
    facts: DataFrame
    types: DataFrame
    calls: DataFrame

    @property
    def step_stats(self) -> DataFrame:
        return A.step_stats(self.facts, self.steps)

    def averages(self, kind: str) -> DataFrame:
        return A.name_avg(self.facts, self.steps, kind)

    @property
    def kernels(self) -> DataFrame:
        return self.averages(S.KERNEL)

    @property
    def triton(self) -> DataFrame:
        return A.triton_avg(self.calls, self.steps)

    @property
    def families(self) -> DataFrame:
        return A.family_avg(self.kernels, self.traces)

    def trace(self, trace_id: str) -> Analysis:
        return Analysis(*(df.filter(F.col("trace_id") == trace_id) for df in (self.traces, self.steps, self.facts, self.types, self.calls)))

    def stored(self, folder: str) -> Analysis:
        """Written by trace and reread: reports and comparisons of stored traces never touch events again."""
        out = []
        for name, df in (("traces", self.traces.select("trace_id", F.lit(True).alias("known"))), ("steps", self.steps), ("facts", self.facts), ("types", self.types), ("calls", self.calls)):
            df.write.mode("overwrite").partitionBy("trace_id").parquet(f"{folder}/{name}")
            out.append(df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}").select(*df.columns))
        return Analysis(out[0].select("trace_id"), *out[1:])


def analyse(events: DataFrame, patterns: Sequence[str] = ()) -> Analysis:
    """``patterns``: types that Triton kernels count for besides; empty ones are dropped. Steps, few as they are, are found once."""
    steps = S.few(S.steps(events))
    placed = X.placed_events(events, steps)
    return Analysis(events.select("trace_id").distinct(), steps, X.step_facts(placed), X.type_facts(placed, patterns), X.triton_calls(placed))


def write_single(one: Analysis, folder: str, step_tables: bool = False, step_code: bool = False) -> None:
    """A trace's result tables as CSV, on request with a table and the code of each step's Triton calls."""
    tables.write_table(present.all_kernels_table(A.kernel_share(one.kernels)), f"{folder}/all_kernels_avg.csv")
    tables.write_table(present.triton_table(A.triton_share(one.triton)), f"{folder}/triton_kernels_avg.csv")
    tables.write_table(present.ops_table(one.averages(S.ATEN)), f"{folder}/aten_ops_avg.csv")
    tables.write_table(present.kernel_types_table(A.family_breakdown(one.families)), f"{folder}/kernel_types_avg.csv")
    tables.write_table(present.ops_table(one.averages(S.COMM)), f"{folder}/cncl_ops_avg.csv")
    rows = R.step_rows(one.calls)
    if step_tables:
        tables.write_step_tables(present.step_table(rows, step_code), folder)
    if step_code:
        tables.write_code_files(rows, folder)


def write_comparison(both: Analysis, a: str, b: str, folder: str) -> None:
    """The five tables that compare trace a with trace b."""
    tables.write_table(present.names_cmp_table(C.compare_names(both.kernels, a, b)), f"{folder}/all_kernels_cmp.csv")
    tables.write_table(present.triton_cmp_table(C.compare_triton(both.triton, a, b)), f"{folder}/triton_kernels_cmp.csv")
    tables.write_table(present.names_cmp_table(C.compare_names(both.averages(S.ATEN), a, b), "op_name"), f"{folder}/aten_ops_cmp.csv")
    tables.write_table(present.names_cmp_table(C.compare_names(both.averages(S.COMM), a, b), "op_name"), f"{folder}/cncl_ops_cmp.csv")
    tables.write_table(present.kernel_types_cmp_table(C.compare_families(both.families, a, b)), f"{folder}/kernel_types_cmp.csv")


def single_report(one: Analysis, top: int = 10, label: str = "") -> str:
    n = one.steps.count()
    parts = (present.summary_report(one.step_stats, label), present.breakdown_report(A.family_breakdown(one.families), n, label), present.top_report(A.top_kernels(one.kernels, top), top, label))
    return "\n".join(p for p in parts if p)


def comparison_report(both: Analysis, a: str, b: str, top: int = 10, labels: Sequence[str] | None = None) -> str:
    """Traces are called by their ids, or by ``labels``."""
    names = labels or (a, b)
    one, other = both.trace(a), both.trace(b)
    metrics = C.compare_metrics(A.step_mean(both.step_stats), a, b)
    parts = [present.comparison_report(one.step_stats, other.step_stats, metrics, C.compare_families(both.families, a, b), *names)]
    parts += [present.top_report(A.top_kernels(x.kernels, top), top, name) for x, name in ((one, names[0]), (other, names[1]))]
    return "\n".join(p for p in parts if p)
