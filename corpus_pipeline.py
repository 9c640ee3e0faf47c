"""The corpus pipeline: its stages in order, each applying one operator to all that the one before kept.

Every stage takes a null text as empty and leaves it null, reads texts whole, judges rows that repeat each by itself,
gives an empty table for an empty one, and passes on all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import exact_dedup, jaccard_join, packing, pii, quality_classifier
from tracemill.llm.bpe import tokenizer_file
from tracemill.llm.shared import documents, stored, unused_name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go. Where labels don't have both classes, all stay."""
    return quality_classifier.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, a null being less than any; null equals empty."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; rows with a null doc_id all do."""
    found = jaccard_join.near_duplicates(docs)
    other = unused_name(docs, "other")
    others = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(other)).distinct(), "others")
    return docs.join(others, F.col("doc_id") == F.col(other), "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the text and is null where that is."""
    found = pii.redacted(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents left, packed into sequences. A null text is one piece of one token."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact),
    ("best-fit packing", pack),
]

#: The first stage is a trained classifier and the last a packing search: SQL can't express run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stage's result written to the shared folder and reread."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
