"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def marked(edges: DataFrame) -> tuple[int, int]:
    """Number and mixed hash of different edges: the same for the same edges, and by chance for others once in 2^64 times."""
    n, mark = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return n, mark


def component_labels(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of the links (a, b).

    Each round, every node joins its larger neighbours to the least node it sees, then its smaller ones (large and small
    star); edges become stars on the least nodes in about as many rounds as the logarithm of a component's size.
    """
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = marked(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        smaller = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(smaller, "b").select(F.col("m").alias("a"), F.explode(F.array("b", "a")).alias("b")).filter("a <> b").distinct()
        edges = stored(small, "edges")
        after = marked(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return nodes.unionByName(edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
