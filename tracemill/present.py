"""Results as users see them: tables of text cells and console reports. Everything here is small and ends on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.formatting import percent, percent_column, signed_percent, signed_percent_column, three_figures_column
from .operators import averages as A
from .operators import compare as C


def _cells(rows: DataFrame, **columns: Column | str) -> DataFrame:
    return rows.select(*((F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()))


def _three(column: str) -> Column:
    return three_figures_column(F.col(column))


def _pct(column: str) -> Column:
    return percent_column(F.col(column))


def all_kernels_table(shared: DataFrame) -> DataFrame:
    """Of kernel_share."""
    rows = shared.orderBy(F.desc("avg_dur_ms"), "name")
    return _cells(rows, kernel_name="name", family="family", avg_count=_three("avg_count"), count_pct=_pct("count_pct"), avg_dur_ms=_three("avg_dur_ms"), dur_pct=_pct("dur_pct"), avg_us_per_call=_three("avg_us_per_call"))


def triton_table(shared: DataFrame) -> DataFrame:
    """Of triton_share."""
    rows = shared.orderBy(F.desc("avg_dur_ms"), "name")
    return _cells(rows, kernel_name="name", avg_count=_three("avg_count"), avg_dur_ms=_three("avg_dur_ms"), dur_pct=_pct("dur_pct"), avg_us_per_call=_three("avg_us_per_call"), avg_io_gb=_three("avg_io_gb"), avg_io_efficiency=_three("avg_io_eff"))


def ops_table(averages: DataFrame, name_field: str = "op_name") -> DataFrame:
    rows = averages.orderBy(F.desc("avg_dur_ms"), "name")
    return _cells(rows, **{name_field: "name", "avg_count": _three("avg_count"), "avg_dur_ms": _three("avg_dur_ms")})


def kernel_types_table(breakdown: DataFrame) -> DataFrame:
    """Of family_breakdown."""
    return _cells(breakdown.orderBy("sort_rank"), type="family", avg_count=_three("avg_count"), count_pct=_pct("count_pct"), avg_dur_ms=_three("avg_dur_ms"), dur_pct=_pct("dur_pct"))


def _changes() -> dict[str, Column]:
    return {"avg_dur_ms_A": _three("avg_dur_ms_A"), "avg_dur_ms_B": _three("avg_dur_ms_B"), "delta_dur_ms": _three("delta_dur_ms"), "pct_change": signed_percent_column(F.col("pct_change")), "avg_count_A": _three("avg_count_A"), "avg_count_B": _three("avg_count_B")}


def names_cmp_table(compared: DataFrame, name_field: str = "kernel_name") -> DataFrame:
    return _cells(C.by_change(compared), **{name_field: "name"}, **_changes())


def triton_cmp_table(compared: DataFrame) -> DataFrame:
    return _cells(C.by_change(compared), kernel_name="name", **_changes(), avg_io_gb_A=_three("avg_io_gb_A"), avg_io_gb_B=_three("avg_io_gb_B"))


def kernel_types_cmp_table(compared: DataFrame) -> DataFrame:
    c = _changes()
    return _cells(compared.orderBy("sort_rank"), type="family", dur_pct_A=_pct("dur_pct_A"), avg_dur_ms_A=c["avg_dur_ms_A"], dur_pct_B=_pct("dur_pct_B"), avg_dur_ms_B=c["avg_dur_ms_B"], delta_dur_ms=c["delta_dur_ms"], pct_change=c["pct_change"], avg_count_A=c["avg_count_A"], avg_count_B=c["avg_count_B"])


def step_table(rows: DataFrame, with_code: bool = False) -> DataFrame:
    """Of triton.step_rows: with step and idx, which the files don't show."""
    ordered = rows.orderBy("step", "idx")
    return _cells(ordered, step="step", idx="idx", **{"kernel_name": "kernel_name", "dur(ms)": _three("dur_ms"), "total io(GB)": _three("io_gb"), "IO efficiency(GB/s)": _three("io_eff"), "tiling config": "tiling", "triton_code_file": "code_file" if with_code else F.lit("")})


# Titles, column heads, widths and number formats of the console reports.
SUMMARY = (("step", 8, "", ""), ("step_dur(ms)", 14, ".3f", ".3f"), ("kernels", 10, "", ".1f"), ("compute_kernel_dur(ms)", 24, ".3f", ".3f"), ("triton", 10, "", ".1f"), ("triton_dur(ms)", 16, ".3f", ".3f"), ("aten_ops", 10, "", ".1f"), ("aten_dur(ms)", 14, ".3f", ".3f"), ("cncl", 8, "", ".1f"), ("cncl_dur(ms)", 14, ".3f", ".3f"))
BREAKDOWN = (("type", 16, ""), ("avg_count", 12, ".1f"), ("count_pct", 11, ""), ("avg_dur_ms", 14, ".3f"), ("dur_pct", 10, ""))
TOP = (("#", 4, ""), ("family", 12, ""), ("dur_pct", 9, ""), ("avg_dur_ms", 14, ".3f"), ("avg_count", 12, ".1f"), ("kernel_name", 0, ""))
METRIC = (("metric", 26, ""), ("A", 18, ".3f"), ("B", 18, ".3f"), ("delta", 14, "+.3f"), ("pct_change", 12, ""))
TYPES = (("type", 16, ""), ("count_A", 10, ".1f"), ("count_B", 10, ".1f"), ("dur_A(ms)", 12, ".3f"), ("dur_B(ms)", 12, ".3f"), ("delta_dur", 12, "+.3f"), ("pct", 10, ""))


def _title(text: str, label: str = "") -> str:
    return f"\n=== {text}{f' — {label}' if label else ''} ==="


def _line(cells, widths, formats=None) -> str:
    specs = [f"<{f[:1].strip('.')}{w or ''}{f.lstrip('+')}" for w, f in zip(widths, formats or [""] * len(widths))]
    return " ".join(format(c, s) for c, s in zip(cells, specs))


def _head(names, widths) -> list[str]:
    head = _line(names, widths)
    return [head, "-" * len(head)]


def summary_report(stats: DataFrame, label: str = "") -> str:
    """Of step_stats of one trace: a line a step, by number, and their mean."""
    rows = stats.orderBy("step").collect()
    mean = A.mean_or_zero(stats).first()
    names, widths = [c[0] for c in SUMMARY], [c[1] for c in SUMMARY]
    out = [_title(f"Per-Step Summary ({len(rows)} steps)", label), *_head(names, widths)]
    out += [_line([r["step"], *(r[m] for m in A.METRICS)], widths, [c[2] for c in SUMMARY]) for r in rows]
    return "\n".join([*out, "-" * len(out[1]), _line(["avg", *(mean[m] for m in A.METRICS)], widths, [c[3] for c in SUMMARY])])


def breakdown_report(breakdown: DataFrame, n_steps: int, label: str = "") -> str:
    rows = breakdown.orderBy("sort_rank").collect()
    widths = [max([16, *(len(r["family"]) for r in rows)]), *(c[1] for c in BREAKDOWN[1:])]
    out = [_title(f"Kernel Type Breakdown (avg across {n_steps} steps)", label), *_head([c[0] for c in BREAKDOWN], widths)]
    return "\n".join(out + [_line([r["family"], r["avg_count"], percent(r["count_pct"]), r["avg_dur_ms"], percent(r["dur_pct"])], widths, [c[2] for c in BREAKDOWN]) for r in rows])


def top_report(top: DataFrame, n: int = 10, label: str = "") -> str:
    """Empty if there are no kernels but collectives."""
    rows = top.orderBy("rank").collect()
    if not rows:
        return ""
    widths = [TOP[0][1], max([12, *(len(r["family"]) for r in rows)]), *(c[1] for c in TOP[2:])]
    out = [_title(f"Top {n} Compute Hotspot Kernels", label), *_head([c[0] for c in TOP], widths)]
    return "\n".join(out + [_line([r["rank"], r["family"], percent(r["dur_pct"]), r["avg_dur_ms"], r["avg_count"], r["short_name"]], widths, [c[2] for c in TOP]) for r in rows])


def comparison_report(stats_a: DataFrame, stats_b: DataFrame, metrics: DataFrame, families: DataFrame, label_a: str, label_b: str) -> str:
    """Both summaries, the nine means and the families side by side."""
    names, widths = [c[0] for c in METRIC], [c[1] for c in METRIC]
    out = [summary_report(stats_a, label_a), summary_report(stats_b, label_b), _title(f"Avg Comparison ({label_a} vs {label_b})"), *_head([names[0], label_a[:16], label_b[:16], *names[3:]], widths)]
    shown = [c[0] for c in SUMMARY[1:]]
    out += [_line([shown[r["place"] - 1], r["A"], r["B"], r["delta"], signed_percent(r["pct_change"])], widths, [c[2] for c in METRIC]) for r in metrics.orderBy("place").collect()]
    rows = families.orderBy("sort_rank").collect()
    widths = [max([16, *(len(r["family"]) for r in rows)]), *(c[1] for c in TYPES[1:])]
    out += [_title(f"Kernel Type Comparison ({label_a} vs {label_b})"), *_head([c[0] for c in TYPES], widths)]
    out += [_line([r["family"], r["avg_count_A"], r["avg_count_B"], r["avg_dur_ms_A"], r["avg_dur_ms_B"], r["delta_dur_ms"], signed_percent(r["pct_change"])], widths, [c[2] for c in TYPES]) for r in rows]
    return "\n".join(out)
