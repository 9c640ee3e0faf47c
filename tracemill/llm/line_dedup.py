"""Line deduplication across documents, in DataFrame functions only.

1. Lines are exploded, normalised and hashed; only hashes travel. Different documents are counted per hash: Spark adds
   up hash and document in every task before it shuffles, then hashes, so a line that all documents have is a row a task.
2. Lines over the threshold are found again by a bitmap of their hashes where documents are read, then by a join on
   the hash, whose large partitions Spark can split. What comes out are the places of lines to drop.
3. Documents with such places get them as one list and are put together again from the stretches between them, in time
   in proportion to their lines. Other documents pass by without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, marked_among, stored, unused_name

LEAST_LENGTH, DOCUMENTS = 40, 5
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text, split at line feeds only; null or empty has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def both_hashes(value: Column, first: str, second: str) -> list[Column]:
    """128 bits: two hashes of different seeds."""
    return [F.xxhash64(value).alias(first), F.xxhash64(F.lit(1), value).alias(second)]


def line_table(docs: DataFrame, least_length: int) -> DataFrame:
    """doc, t1, t2 (its text's hashes), at, h1, h2 of every line whose key is long enough. Rows with a null doc_id aren't there."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), *both_hashes(text, "t1", "t2"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keys = rows.select("doc", "t1", "t2", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least_length)
    return keys.select("doc", "t1", "t2", "at", *both_hashes(F.col("key"), "h1", "h2"))


def frequent_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = DOCUMENTS) -> DataFrame:
    """h1, h2, n, keep of every line found in enough documents: its hashes, the number of documents and the largest doc_id among them."""
    counted = line_table(docs, least_length).groupBy("h1", "h2").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("keep"))
    return stored(counted.filter(F.col("n") >= least_documents), "frequent-lines")


def places_to_drop(docs: DataFrame, frequent: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc, t1, t2, places: the places of lines that go, in rising order, for each document and text that has some."""
    lines = marked_among(line_table(docs, least_length), frequent.select("h1"), "h1", "may").filter("may")
    gone = lines.join(frequent.select("h1", "h2", "keep"), ["h1", "h2"]).filter("doc <> keep")
    # rows that repeat an id and a text have the same places
    return stored(gone.groupBy("doc", "t1", "t2").agg(F.array_sort(F.collect_set("at")).alias("places")), "dropped-lines")


def without(lines: Column, places: Column) -> Column:
    """``lines`` without those at ``places`` (in rising order, from 0): the stretches between them, one after the other."""
    begin = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    end = F.concat(places, F.array(F.size(lines)))
    return F.flatten(F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda z: F.slice(lines, z["b"] + 1, z["e"] - z["b"])))


def deduplicated(docs: DataFrame, lines: str = "n_lines", dropped: str = "n_dropped", least_length: int = LEAST_LENGTH, least_documents: int = DOCUMENTS) -> DataFrame:
    """A row per row of ``docs`` with its columns, ``text`` without the lines that go, and two counts: lines before, lines dropped.

    A line whose key (``line_key``) has at least ``least_length`` code points and is in at least ``least_documents``
    documents goes from all of them but the one of largest doc_id; that one keeps all its lines. Rows that repeat a
    doc_id are one document here. Rows with a null doc_id aren't counted and lose nothing. A null text stays null and
    counts as one empty line, as an empty one does; where all lines go the text is empty. Texts count whole, however
    long. An empty table gives an empty one. Columns of any
    name pass; a count whose name ``docs`` has gets underscores.
    """
    names = ["doc", "t1", "t2", "places"]
    doc, t1, t2, places, may, split = (unused_name(docs, n) for n in ("__doc", "__t1", "__t2", "__places", "__may", "__lines"))
    lines, dropped = unused_name(docs, lines), unused_name(docs, dropped)
    own1, own2 = unused_name(docs, "__own1"), unused_name(docs, "__own2")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    gone = places_to_drop(docs, frequent_lines(docs, least_length, least_documents), least_length)
    marked = marked_among(docs, gone.select("doc"), "doc_id", may)
    untouched = marked.filter(~F.col(may)).select(*columns, F.size(lines_of(F.col("text"))).cast("long").alias(lines), F.lit(0).cast("long").alias(dropped))
    hashed = marked.filter(may).select(*columns, *both_hashes(F.coalesce(F.col("text"), F.lit("")), own1, own2))
    found = gone.select(*(F.col(c).alias(n) for c, n in zip(names, (doc, t1, t2, places))))
    joined = hashed.join(found, (F.col("doc_id") == F.col(doc)) & (F.col(own1) == F.col(t1)) & (F.col(own2) == F.col(t2)), "left").withColumn(split, lines_of(F.col("text")))
    left = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(without(F.col(split), F.col(places)), "\n"))
    touched = joined.select(*(left.alias(c) if c == "text" else column for c, column in zip(docs.columns, columns)), F.size(split).cast("long").alias(lines), F.coalesce(F.size(places), F.lit(0)).cast("long").alias(dropped))
    return untouched.unionByName(touched)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM split),
     keyed AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
     often AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= {LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCUMENTS}),
     marked AS (SELECT doc_id, pos, line, keep IS NOT NULL AND doc_id <> keep AS gone FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
