"""Searching, filtering, sorting and summing result tables, whose cells may be any text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_float
from ..store import stored

TEXT_OPERATORS, NUMBER_OPERATORS = ("~", "!~"), (">=", "<=", ">", "<", "=")


def cell(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def search(rows: DataFrame, query: str) -> DataFrame:
    """Rows of which some cell contains the query, whatever its case. An empty query keeps all."""
    if not query:
        return rows
    return rows.filter(reduce(lambda a, b: a | b, (F.lower(cell(c)).contains(query.lower()) for c in rows.columns)))


def condition(column: str, operator: str, value: str) -> Column:
    """~ and !~: the cell contains one of the terms between |, or none. Others compare the numbers that cell and value begin with: cells without one fail, a value without one keeps all."""
    if operator in TEXT_OPERATORS:
        terms = [t.lower() for t in value.split("|") if t]
        hit = reduce(lambda a, b: a | b, (F.lower(cell(column)).contains(t) for t in terms), F.lit(False))
        return hit if operator == "~" else ~hit
    if operator not in NUMBER_OPERATORS:
        return F.lit(True)
    number, own = parse_float(F.lit(value)), parse_float(cell(column))
    compared = {">=": own >= number, "<=": own <= number, ">": own > number, "<": own < number, "=": own == number}[operator]
    return F.when(number.isNull(), True).otherwise(F.coalesce(compared, F.lit(False)))


def filtered(rows: DataFrame, conditions: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rows that all (column, operator, value) allow; empty values don't count."""
    return reduce(lambda df, c: df.filter(condition(*c)), (c for c in conditions if c[2]), rows)


def sort_keys(column: str, ascending: bool = True) -> list[Column]:
    """By the number that cells begin with, then by text; cells without a number come last when rising. Zero is a number like others."""
    number, text = parse_float(cell(column)), cell(column)
    return [number.asc_nulls_last(), text.asc()] if ascending else [number.desc_nulls_first(), text.desc()]


def sorted_rows(rows: DataFrame, column: str, ascending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    return rows.orderBy(*sort_keys(column, ascending), *ties)


def placed_rows(rows: DataFrame, column: str, ascending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """All rows with their place (from 1) in the order of ``sorted_rows``."""
    return placed(sorted_rows(rows, column, ascending, ties))


def placed(rows: DataFrame) -> DataFrame:
    """All rows of a sorted frame with their place (from 1) in its order. Spark sorts by ranges, a task each; every range counts its own, and begins after those before it."""
    come = stored(rows.withColumns({"__range": F.spark_partition_id(), "__come": F.monotonically_increasing_id()}), "ranges")
    # a row a range, so few
    first = come.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__come").alias("__first"))
    before = first.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n") - F.col("__first")).alias("__before"))
    # within a range the numbers that Spark gives follow each other
    return come.join(F.broadcast(before), "__range").select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("__come") + F.col("__before") + 1).alias("place"))


def sums(rows: DataFrame) -> DataFrame:
    """One row: each column's sum of the numbers that its cells begin with; null for efficiencies, columns with a % cell and columns without numbers."""

    def total(column: str) -> Column:
        if "efficiency" in column.lower():
            return F.lit(None).cast("double")
        return F.when(~F.coalesce(F.bool_or(F.trim(cell(column)).endswith("%")), F.lit(False)), F.sum(parse_float(cell(column))))

    return rows.agg(*(total(c).alias(c) for c in rows.columns))


def shares(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows with a positive value, and each one's share of their sum (for a pie), within groups ``by``."""
    positive = rows.filter(F.col(value) > 0)
    if by:
        return positive.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(*by)))
    # without groups the total is one number, taken by a partial sum in each task
    total = positive.agg(F.sum(value).alias("__total"))
    return positive.join(F.broadcast(total)).withColumn("share", F.col(value) / F.col("__total")).drop("__total")


def bars(rows: DataFrame, type_column: str, *values: str) -> DataFrame:
    """The series of a bar chart: one value a type, or two of a comparison."""
    return rows.select(type_column, *values)


def first_steps(names: DataFrame, column: str = "name", n: int = 3) -> DataFrame:
    """The first step files in the order of their names, as tabs show them."""
    return names.filter(F.col(column).startswith("step_")).orderBy(column).limit(n)
