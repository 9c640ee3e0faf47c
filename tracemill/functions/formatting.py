"""Numbers as reports show them: rounded half-even on the binary value, which Spark's own formatting doesn't do.

The functions work on Python numbers; the columns are Arrow functions, meant for result tables, which are small.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def three_figures(value: float | None) -> str:
    """Three significant figures without an exponent; null is empty."""
    return "" if value is None else format(Decimal(f"{float(value):.3g}"), "f")


def percent(share: float | None) -> str:
    return "" if share is None else f"{share:.1f}%"


def signed_percent(change: float | None) -> str:
    return "" if change is None else f"{change:+.1f}%"


def plain_sum(value: float | None) -> str:
    """A whole number as it is, others to three decimals without trailing zeros."""
    if value is None:
        return ""
    return str(int(value)) if float(value).is_integer() else f"{value:.3f}".rstrip("0").rstrip(".")


def _column(function):
    @F.arrow_udf(StringType())
    def formatted(values: pa.Array) -> pa.Array:
        return pa.array([function(v) for v in values.to_pylist()], pa.string())

    def apply(value: Column) -> Column:
        return formatted(value.cast("double"))

    return apply


three_figures_column, percent_column, signed_percent_column, plain_sum_column = map(_column, (three_figures, percent, signed_percent, plain_sum))
