"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shortened(name: Column, most: int = 55) -> Column:
    """Names beyond ``most`` characters end in three dots at that length."""
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).otherwise(name)


def label(text: Column) -> Column:
    return F.substring(text, 1, 16)


def one_line(text: Column) -> Column:
    """Line feeds as \\n, no carriage returns, null as empty."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit(""))


def code_file_name(idx: Column, name: Column) -> Column:
    return F.concat(F.lit("kernel_"), idx.cast("string"), F.lit("_"), F.translate(name, "/ ", "__"), F.lit(".py"))


def hundredths(value: Column) -> Column:
    """A number rounded half-even to two decimals on its binary value: 2.675, which is a little less, gives 2.67. Scaled by a power of two it is whole, so its hundredths divide without error."""
    size = F.abs(value)
    bits = F.lit(52) - F.floor(F.log2(size)).cast("int")
    shift = F.least(bits, F.lit(62))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    scaled = (size * F.pow(F.lit(2.0), bits)).cast("long") * 100
    whole = F.call_function("shiftright", scaled, shift)
    rest = scaled - whole * unit
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    # from 2^52 on all doubles are whole; below 2^-9 nothing is left
    return F.when(F.isnan(value) | (size >= 2.0**52), value).when(size < 2.0**-9, value * 0.0).otherwise(F.signum(value) * (whole + up.cast("long")) / 100.0)


def measured_gb_s(stdout: Column) -> Column:
    """Throughput of a program's output: of three or more words the last, a number with or without GB/s, to two decimals (``hundredths``); else null."""
    words = F.split(F.regexp_replace(stdout, r"^\s+|\s+$", ""), r"\s+")
    number = F.replace(F.element_at(words, -1), F.lit("GB/s"), F.lit("")).try_cast("double")
    # a lambda's argument is worked out once; written out, every use of it would parse the text again
    once = F.element_at(F.transform(F.array(number), hundredths), 1)
    return F.when(F.size(words) >= 3, once)


def first_gb_s(text: Column) -> Column:
    """The first number before GB/s anywhere in a text; null if none."""
    return F.nullif(F.regexp_extract(text, r"([\d.]+)\s*GB/s", 1), F.lit("")).try_cast("double")


def parse_float(text: Column) -> Column:
    """The number that a text begins with, as in 12.3%; null if it begins with none."""
    bare = F.regexp_replace(text.cast("string"), r"^\s+", "")
    return F.nullif(F.regexp_extract(bare, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0), F.lit("")).try_cast("double")


def short_date(text: Column) -> Column:
    return F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 16)


def change_class(field: str, value: Column) -> Column:
    """worse, better or same for a change of time; null for fields that are no change."""
    if "delta" not in field and field != "pct_change":
        return F.lit(None).cast("string")
    number = parse_float(value)
    return F.when(number > 0, "worse").when(number < 0, "better").when(number == 0, "same")


# What a result file's tab and a job's state are called.
TAB_LABELS = {"all_kernels_avg.csv": "All Kernels", "kernel_types_avg.csv": "Kernel Types", "triton_kernels_avg.csv": "Triton Kernels", "aten_ops_avg.csv": "ATen Ops", "cncl_ops_avg.csv": "CNCL Ops", "all_kernels_cmp.csv": "All Kernels", "kernel_types_cmp.csv": "Kernel Types", "triton_kernels_cmp.csv": "Triton Kernels", "aten_ops_cmp.csv": "ATen Ops", "cncl_ops_cmp.csv": "CNCL Ops"}


STATUS_SIGNS = {"pending": "⏳", "running": "⟳", "done": "✓", "error": "✗"}


def status_sign(status: Column) -> Column:
    """The sign of a job's state; an unknown state as it is."""
    return looked_up(status, STATUS_SIGNS, status)


def tab_label(file: Column) -> Column:
    """What a result file's tab is called; an unknown file by its name."""
    return looked_up(file, TAB_LABELS, file)


def looked_up(key: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key], default)


def console_line(line: Column) -> Column:
    """header, separator, wrote, blank or data."""
    return F.when(line.rlike("^={3,}"), "header").when(line.rlike("^-{5,}"), "separator").when(line.rlike("^Wrote "), "wrote").when(line.rlike(r"^\s*$"), "blank").otherwise("data")


def older_than_days(time: Column, now: Column, days: int = 10) -> Column:
    return time < now - F.make_dt_interval(F.lit(days))
