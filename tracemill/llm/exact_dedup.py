"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries, one per task, find the digests that many rows share. A second pass verifies them: it counts
them exactly. The verified winners, at most ``counters`` rows, are broadcast and their copies are settled where they
are read. All other digests have less than 2 / (counters + 1) of the rows each and are shuffled as usual.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, stored

COUNTERS = 1024
SALTS = 64
_DIGEST, _ID, _TOP, _SIZE, _TURN = "__digest", "__doc_id", "__top_id", "__group_size", "__turn"


def shrink(counts: Counter, counters: int) -> Counter:
    """A Misra-Gries summary of at most ``counters`` entries: the first count that no longer fits is taken off all."""
    if len(counts) <= counters:
        return counts
    off = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: n - off for k, n in counts.items() if n > off})


def summaries(digests: DataFrame, counters: int) -> DataFrame:
    """digest, at_least: what each task keeps; a null digest carries the task's number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = Counter(), 0
        for batch in batches:
            seen = Counter(batch.column(0).to_pylist())
            rows += batch.num_rows
            kept = shrink(kept + seen, counters)
        yield pa.RecordBatch.from_pydict({"digest": [None, *kept], "at_least": pa.array([rows, *kept.values()], pa.int64())}, schema=pa.schema([("digest", pa.string()), ("at_least", pa.int64())]))

    return digests.select(_DIGEST).mapInArrow(count, "digest string, at_least long")


def heavy_hitters(digests: DataFrame, counters: int) -> DataFrame:
    """digest, top id and exact number of rows of the verified winners: every digest with more than 2 / (counters + 1) of the rows, and at most ``counters`` rows."""
    found = stored(summaries(digests, counters).groupBy("digest").agg(F.sum("at_least").alias("at_least")), "frequent")
    rows = found.filter("digest IS NULL").agg(F.coalesce(F.sum("at_least"), F.lit(0))).first()[0]
    candidates = found.filter(F.col("digest").isNotNull() & (F.col("at_least") * (counters + 1) > rows)).select(F.col("digest").alias(_DIGEST))
    exact = digests.join(F.broadcast(candidates), _DIGEST).groupBy(_DIGEST).agg(F.max(_ID).alias(_TOP), F.count("*").alias(_SIZE))
    return stored(exact.filter((F.col(_SIZE) * (counters + 1) > rows) & (F.col(_SIZE) > 1)), "heavy")


def digested(docs: DataFrame, *more) -> DataFrame:
    return docs.select(*more, F.col("doc_id").alias(_ID), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias(_DIGEST))


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """A row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text equals an empty one. The largest doc_id of a group stays (null is less than any); of rows that repeat
    that doc_id too, one stays. Other columns are not looked at. An empty table gives none.
    """
    digests = stored(digested(docs), "digests")
    marked = digests.join(F.broadcast(heavy_hitters(digests, counters)), _DIGEST, "left")
    of_group = Window.partitionBy(_DIGEST)
    light = (
        marked.filter(F.col(_SIZE).isNull())
        .withColumn(_SIZE, F.count("*").over(of_group))
        .withColumn(_TOP, F.max(_ID).over(of_group))
        .withColumn(_TURN, F.row_number().over(of_group.orderBy(F.desc_nulls_last(_ID))))
    )
    settled = marked.filter(F.col(_SIZE).isNotNull())
    is_top = F.col(_ID).eqNullSafe(F.col(_TOP))
    lost = settled.filter(~is_top).withColumn(_TURN, F.lit(2))
    # rows that repeat the winner's id: the first of each salt, then the first of those
    salted = settled.filter(is_top).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    salted = salted.withColumn(_TURN, F.row_number().over(Window.partitionBy(_DIGEST, "__salt").orderBy(_ID)))
    again = salted.filter(F.col(_TURN) > 1)
    finals = salted.filter(F.col(_TURN) == 1).withColumn(_TURN, F.row_number().over(of_group.orderBy("__salt")))
    every = light.unionByName(lost).unionByName(again.drop("__salt")).unionByName(finals.drop("__salt"))
    return every.select(F.col(_ID).alias("doc_id"), F.col(_TOP).alias("keep_id"), F.col(_SIZE).alias("group_size"), (F.col(_TURN) == 1).alias("kept"), F.col(_DIGEST).alias("text_sha256"))


def distinct_documents(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that exact_duplicates keeps, with the columns of ``docs``.

    Copies of heavy hitters go where they are read. For the rest each task passes on one row per digest at most: Spark
    applies a filter on row_number() before the shuffle too. Nulls, repeated rows and empty tables are as in
    exact_duplicates; columns of any name are passed on.
    """
    heavy = heavy_hitters(stored(digested(docs), "digests"), counters)
    names = [f"c{k}" for k in range(len(docs.columns))]
    marked = digested(docs, *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names))).join(F.broadcast(heavy), _DIGEST, "left")
    left = marked.filter(F.col(_SIZE).isNull() | F.col(_ID).eqNullSafe(F.col(_TOP)))
    turn = F.row_number().over(Window.partitionBy(_DIGEST).orderBy(F.desc_nulls_last(_ID)))
    return left.withColumn(_TURN, turn).filter(F.col(_TURN) == 1).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
