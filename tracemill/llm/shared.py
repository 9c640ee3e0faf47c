"""What several operators need: reading documents and writing intermediate tables where every executor can read them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import clear_stored, shared_folder, stored

__all__ = ["among", "bounded_batches", "by_slices", "clear_stored", "documents", "marked_among", "shared_folder", "stored", "text_bytes", "unused_name"]


SLICE_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


BATCH_BYTES = 16 * 2**20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after the session's Arrow batches are set to at most BATCH_BYTES: a task holds a batch on both sides, and several copies while it works."""
    conf = docs.sparkSession.conf
    now = conf.get(_BATCH)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return docs


def among(docs: DataFrame, ids: DataFrame, most_bits: int = 27) -> DataFrame:
    """The rows of ``docs`` whose ``doc`` may be in ``ids``: all that are, and a few others. Their bitmap takes 4 KB to 16 MB, whatever their number, and rows are dropped where they are read."""
    bits = min(most_bits, max(15, (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc"), F.lit(2**bits))
    bitmap = ids.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("bits"))
    placed = docs.withColumn("p", place).withColumn("part", F.expr("p div 32768"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(p % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
    return placed.join(F.broadcast(bitmap), "part").filter((byte.bitwiseAND(F.expr("shiftleft(1, cast(p % 8 as int))")) != 0)).select(*docs.columns)


def marked_among(docs: DataFrame, ids: DataFrame, on: str, flag: str, most_bits: int = 27) -> DataFrame:
    """``docs`` with a boolean column ``flag``: true for all rows whose ``on`` is in the first column of ``ids``, of the same type, and for a few others. Their bitmap takes 4 KB to 16 MB, whatever their number; it is looked up where rows are read."""
    bits = min(most_bits, max(15, (16 * ids.count()).bit_length()))
    place, part, held = (unused_name(docs, n) for n in ("p", "part", "bits"))
    at = lambda column: F.pmod(F.xxhash64(column), F.lit(2**bits))
    bitmap = ids.select(at(ids.columns[0]).alias(place)).groupBy(F.expr(f"{place} div 32768").alias(part)).agg(F.expr(f"bitmap_construct_agg({place} % 32768)").alias(held))
    placed = docs.withColumn(place, at(on)).withColumn(part, F.expr(f"{place} div 32768"))
    byte = F.conv(F.hex(F.expr(f"substring({held}, cast({place} % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr(f"shiftleft(1, cast({place} % 8 as int))")) != 0
    return placed.join(F.broadcast(bitmap), part, "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop(place, part, held)


def unused_name(df: DataFrame, wanted: str = "own") -> str:
    """A column name that ``df`` doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wanted in taken:
        wanted += "_"
    return wanted


def text_bytes(column: str = "text") -> Column:
    """A text in UTF-8, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def by_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """First and last row of slices of about ``limit`` bytes of text."""
    begin = size = 0
    for i, value in enumerate(batch.column(column)):
        size += value.as_buffer().size if value.is_valid else 0
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield begin, batch.num_rows
