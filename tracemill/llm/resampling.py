"""Importance resampling towards a target distribution, over hashed word n-grams.

1. Each document's features are counted by bucket. Many documents make a block of a sparse matrix by rows (CSR): how many
   entries each row has, the entries' columns as differences, their counts. Blocks are written once.
2. The matrix' column sums are the corpus' distribution; the target's is made the same way. Both are one number a bucket,
   so a bucket's gain is settled on the driver: its memory depends on the number of buckets only.
3. The matrix times the gains gives every document's sum of gains, a block at a time, from what was written: texts
   aren't read again.
4. Scores are whole numbers within a bounded range. Their histogram gives the score at which the draw ends; documents down to it are
   ranked by ranges of the order, each counted from what comes before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, by_slices, documents, stored, text_bytes

BUCKETS, WIDEST = 10_000, 2
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
#: A-Z lower-cased; digits, a-z and all bytes above ASCII belong to words, the rest parts them.
WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
BLOCK = "ids binary, words binary, entries binary, columns binary, counts binary"


def counted(texts: list[bytes], buckets: int = BUCKETS, widest: int = WIDEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of words and of different buckets of each text; the buckets, in rising order by text; how often each occurs."""
    split = [t.translate(WORDS).split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    flat = [w for words in split for w in words]
    owner = np.repeat(np.arange(len(texts)), n)
    code = list(map(crc32, flat))
    codes, owners = [np.array(code, np.int64)], [owner]
    for width in range(2, widest + 1):
        # the run of one word less that ends before a word, a space, the word
        code = list(map(crc32, flat[width - 1 :], map(crc32, repeat(b" "), code)))
        within = owner[width - 1 :] == owner[: len(code)]
        codes.append(np.array(code, np.int64)[within])
        owners.append(owner[: len(code)][within])
    keys, counts = np.unique(np.concatenate(owners) * buckets + np.concatenate(codes) % buckets, return_counts=True)
    return n, np.bincount(keys // buckets, minlength=len(texts)), keys % buckets, counts


def matrix(docs: DataFrame, buckets: int = BUCKETS, widest: int = WIDEST) -> DataFrame:
    """BLOCK: rows of the document-by-bucket matrix, some megabytes of text together; ids, numbers of words and of entries a row, and the entries. Ids end in a bit that tells null ones. Written once."""
    schema = pa.schema([(c.split()[0], pa.binary()) for c in BLOCK.split(", ")])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, b in by_slices(batch, 1):
                ids, texts = (c.slice(a, b - a) for c in batch.columns)
                words, entries, columns, counts = counted(texts.to_pylist(), buckets, widest)
                begin = np.cumsum(entries) - entries
                steps = np.diff(columns, prepend=0)
                steps[begin[entries > 0]] = columns[begin[entries > 0]]
                known = np.array([x.is_valid for x in ids], np.int64)
                parts = np.stack([ids.fill_null(0).to_numpy(zero_copy_only=False), known]).T.astype("<i8"), words.astype("<i8"), entries.astype("<u4"), steps.astype("<u4"), counts.astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([coder.compress(planes(p))], pa.binary()) for p in parts], schema=schema)

    return stored(bounded_batches(docs).select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(blocks, BLOCK), "matrix")


def planes(values: np.ndarray) -> bytes:
    """The bytes of whole numbers, all lowest ones first: high ones are mostly zero and pack well."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def numbers(packed: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel().astype(np.int64)


def entries_of(entries: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's entries end, with 0 before the first, and the entries' columns."""
    ends = np.r_[0, np.cumsum(entries)]
    total = np.r_[0, np.cumsum(steps)]
    # steps begin anew in each row
    return ends, total[1:] - np.repeat(total[ends[:-1]], entries)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows: a table a task, added by Spark, one number a bucket at the end."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                entries, steps, counts = (numbers(x, "<u4") for x in row)
                total += np.bincount(entries_of(entries, steps)[1], counts, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    rows = blocks.select("entries", "columns", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How much likelier each bucket is in the target than in the corpus, both with one more of each: 1000 times the logarithm, rounded down."""
    n, s, t = float(len(corpus)), corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row: the matrix times the gains, over the row's features, rounded down; 0 without features."""
    shipped = blocks.sparkSession.sparkContext.broadcast(gain)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, entries, columns, counts in zip(*(c.to_pylist() for c in batch.columns)):
                ends, column = entries_of(numbers(entries, "<u4"), numbers(columns, "<u4"))
                counts = numbers(counts, "<u4")
                n, total = (np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (counts, counts * shipped.value[column]))
                known = numbers(ids, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(known[:, 0], pa.int64(), mask=known[:, 1] == 0), *(pa.array(x, pa.int64()) for x in (numbers(words, "<i8"), n, total // np.maximum(n, 1)))], schema=schema)

    return blocks.mapInArrow(times, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """All rows with their place (``rank``, from 1) in ``order``. Ranges of the order are numbered apart, each from the count of those before; equal rows are spread over ranges."""
    spread = rows.withColumn("turn", F.monotonically_increasing_id())
    keys = [*order, F.col("turn")]
    within = stored(spread.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()), "ranges")
    counts = within.groupBy("range").agg(F.count("*").alias("n"))
    # a row a range, so few
    starts = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    numbered = within.withColumn("own", F.row_number().over(Window.partitionBy("range").orderBy(*keys)))
    return numbered.join(F.broadcast(starts), "range").select(*rows.columns, (F.col("own") + F.col("start")).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, widest: int = WIDEST) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank; rank is null for rows that aren't drawn.

    ``percent`` of the rows with at least ``least_words`` words are drawn without replacement, by highest score: weight
    plus Gumbel noise from ``seed`` and doc_id. Ties go to the smaller doc_id, then to more features. A null text has no
    words and no features, as an empty one: weight 0. A null doc_id has no score and isn't drawn nor counted. Rows that
    repeat a doc_id are drawn each for itself, with the same noise. Texts count whole, however long. Of an empty table
    nothing is drawn; an empty target has the same share of every bucket. Other columns aren't read.
    """
    blocks = matrix(docs, buckets, widest)
    wanted = matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, widest)
    weights = weighted(blocks, gains(column_sums(blocks, buckets), column_sums(wanted, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weights.withColumn("score", F.col("weight") + noise), "scores")
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    # scores are logarithms times 1000: some ten thousand different ones, whatever the number of documents
    bars = sorted(((r["score"], r["count"]) for r in scored.filter(may).groupBy("score").count().collect()), reverse=True)
    draw = percent * sum(n for _, n in bars) // 100
    cut = next((score for (score, _), reached in zip(bars, accumulate(n for _, n in bars)) if reached >= draw), None) if draw else None
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    enough = may & (F.col("score") >= cut)
    drawn = ranked(scored.filter(enough), [F.desc("score"), F.asc("doc_id"), F.desc("n_features"), F.desc("weight")])
    rest = scored.filter(~F.coalesce(enough, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(rest)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: The crc32 of a text's bytes by its definition: a table of 256 values, then a step a byte.
ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
          UNION ALL SELECT 't', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
different AS (SELECT f, hex(f) AS h, count(*) AS n FROM features GROUP BY f),
buckets AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM different, crc),
named AS (SELECT side, doc_id, bucket FROM features JOIN buckets USING (f)),
counts AS (SELECT b.range AS bucket, count(*) FILTER (WHERE side = 'd')::DOUBLE AS s, count(*) FILTER (WHERE side = 't')::DOUBLE AS t FROM range(10000) b LEFT JOIN named ON bucket = b.range GROUP BY b.range),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counts),
weights AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM named JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM texts d LEFT JOIN weights USING (doc_id) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank FROM placed
"""
