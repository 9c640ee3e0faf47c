"""Result tables as CSV files, in the dialect of the files that users have: CRLF, quotes only where needed and doubled, empty for null."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from uuid import uuid4

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triton import join_measured
from ..schema import METADATA
from ..store import file_system
from .archives import ROWS, SQLITE, SqliteTable
from .files import write_files

END = "\r\n"

# The result files in the order in which they are shown.
RESULTS = ("all_kernels_avg.csv", "kernel_types_avg.csv", "triton_kernels_avg.csv", "aten_ops_avg.csv", "cncl_ops_avg.csv", "all_kernels_cmp.csv", "kernel_types_cmp.csv", "triton_kernels_cmp.csv", "aten_ops_cmp.csv", "cncl_ops_cmp.csv")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, empty ones empty; a missing file is an empty table without columns."""
    try:
        found = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False, emptyValue="", nullValue="\0")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "")
        raise
    return found.na.fill("")


def csv_cell(value: Column) -> Column:
    """A cell in DIALECT: quoted if it holds a comma, a quote or a line break, null as empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(columns: list[str]) -> Column:
    return F.concat_ws(",", *(csv_cell(F.col(f"`{c}`")) for c in columns))


def csv_head(columns: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\r\n') else c for c in columns)


def moved(spark: SparkSession, source: str, path: str) -> None:
    """Puts a file in the place of ``path``. A file there is set aside until that is done; a folder there is an error."""
    fs, to = file_system(spark, path)
    fs.mkdirs(to.getParent())
    aside = None
    if fs.exists(to):
        if fs.getFileStatus(to).isDirectory():
            raise IsADirectoryError(path)
        aside = file_system(spark, f"{path}.before-{uuid4().hex}")[1]
        fs.rename(to, aside)
    if not fs.rename(file_system(spark, source)[1], to):
        if aside:
            fs.rename(aside, to)
        raise OSError(f"can't write {path}")
    if aside:
        fs.delete(aside, False)


def part_files(spark: SparkSession, folder: str) -> list[str]:
    fs, path = file_system(spark, folder)
    found = fs.listStatus(path)
    return sorted(s.getPath().toString() for s in found if s.getPath().getName().startswith("part-"))


def write_table(rows: DataFrame, path: str) -> None:
    """One CSV file as users have it, rows in order if ``rows`` are. Result tables are small, so one file holds them.

    Lines are put together here: Spark's CSV writer turns line feeds within cells into the line separator.
    """
    lines = rows.select(csv_line(rows.columns).alias("line"))
    head, spark = csv_head(rows.columns), rows.sparkSession

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"line": [head]})
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names=["line"])

    # beside the result, so that the file only has to be renamed
    aside = f"{path}.new-{uuid4().hex}"
    lines.coalesce(1).mapInArrow(headed, "line string").write.option("lineSep", END).text(aside)
    moved(spark, part_files(spark, aside)[0], path)
    fs, at = file_system(spark, aside)
    fs.delete(at, True)


def export_view(rows: DataFrame, conditions, query: str, path: str) -> None:
    """The rows that a grid's search and filters leave, as a file."""
    from ..operators.grid import filtered, search

    write_table(filtered(search(rows, query), conditions), path)


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, path of a folder's results: RESULTS that are there, in their order, then step files by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    place = F.array_position(F.array(*map(F.lit, RESULTS)), name)
    is_step = name.rlike(r"^step_.*_triton_kernels\.csv$")
    return files.select(name.alias("name"), "path", F.when(place > 0, place).when(is_step, len(RESULTS) + 1).alias("place")).filter("place IS NOT NULL").orderBy("place", "name").select("name", "path")


def write_step_tables(rows: DataFrame, path: str) -> None:
    """step_N_triton_kernels.csv in ``path`` for each step of ``rows``; their other columns but idx, in the order of idx. All at once, or none (``files``)."""
    columns = [c for c in rows.columns if c not in ("step", "idx")]
    lines = rows.select("step", "idx", csv_line(columns).alias("line"))
    heads = rows.select("step").distinct().select("step", F.lit(-1).alias("idx"), F.lit(csv_head(columns)).alias("line"))
    named = F.concat(F.lit("step_"), "step", F.lit("_triton_kernels.csv"))
    write_files(lines.unionByName(heads).select(named.alias("file"), F.concat("line", F.lit(END)).alias("text"), "idx"), path, "idx")


def write_code_files(rows: DataFrame, path: str) -> None:
    """The code of each call in a file of its own, ``path``/step_N_triton_codes/kernel_....py; it ends in a line feed. All at once, or none (``files``): a step's files are written by one task and put in place together."""
    write_files(rows.select(F.col("code_file").alias("file"), F.concat(F.regexp_replace("code", "\n$", ""), F.lit("\n")).alias("text")), path)


EFFICIENCY = "local efficiency"


def add_efficiency(spark: SparkSession, folder: str, measurements: DataFrame) -> list[str]:
    """Writes the column EFFICIENCY into a folder's step tables and triton_kernels_avg.csv, from rows (code_key, pos, eff), and returns their names.

    Each kernel gets the first value of a key that contains its name, empty if there is none. Done again it gives the
    same: the column is replaced.
    """
    names = [r["name"] for r in result_files(spark, folder).collect() if r["name"].startswith("step_") or r["name"] == "triton_kernels_avg.csv"]
    for name in names:
        own = read_table(spark, f"{folder}/{name}")
        place = own.drop(EFFICIENCY).withColumn("__place", F.monotonically_increasing_id())
        joined = join_measured(place, measurements).orderBy("__place").withColumnRenamed("local_efficiency", EFFICIENCY)
        write_table(joined.select(*place.columns[:-1], EFFICIENCY), f"{folder}/{name}")
    return names


def read_metadata(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the METADATA tables from ``folder``/name as Parquet, or else as CSV with a header; missing columns are null."""
    fs, path = file_system(spark, f"{folder}/{name}.parquet")
    wanted = spark.createDataFrame([], METADATA[name])
    if fs.exists(path):
        found = spark.read.parquet(f"{folder}/{name}.parquet")
    else:
        found = spark.read.csv(f"{folder}/{name}.csv", header=True, quote='"', escape='"', multiLine=True)
    return found.select(*((F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.schema))


def read_database(spark: SparkSession, path: str | Sequence[str], name: str, rows: int = ROWS, wanted: Mapping[str, Sequence[str]] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One of the METADATA tables from a SQLite file or several, ``rows`` row ids a task; missing columns are null. ``wanted``: text columns with the values to read, chosen in the database. ``columns``: those to read, if not all."""
    spark.dataSource.register(SqliteTable)
    shown = [f for f in METADATA[name].split(", ") if columns is None or f.split(" ")[0] in columns]
    options = {"paths": json.dumps([path] if isinstance(path, str) else [*path]), "table": name, "columns": ", ".join(shown), "rows": rows, "wanted": json.dumps({c: [*v] for c, v in (wanted or {}).items()})}
    return spark.read.format(SQLITE).options(**options).load()
