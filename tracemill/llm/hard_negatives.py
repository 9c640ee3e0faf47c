"""Hard-negative mining by exact inner products over inverted lists.

1. Vectors become whole numbers. A k-means fitted to a bounded sample gives centroids; every row goes to the list of its
   nearest one, and each list's radius is stored: the largest distance of a row from the centroid. A list is kept in
   parts of some thousand rows, so one that holds a third of all rows is as many parts.
2. With an anchor q, a row of a list with centroid c and radius r has an inner product of at least q.c - |q| r and at most
   q.c + |q| r (Cauchy-Schwarz). An anchor first visits the few lists of highest upper bound that its windows touch. Then it visits
   every other list that still may hold one of its answers: those whose upper bound isn't strictly below the kth score
   found, and that lie not wholly outside its windows.
3. A visit is a join of packed anchors with the parts of a list, on the list; products are made in blocks. Of each part
   only the best few of an anchor go on.

First every anchor's positives are found so, with one window without ends; then its negatives, with a window for each positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, stored

SCALE = 256
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95
SAMPLE, CENTROIDS, TURNS = 16_384, 1024, 8
PART, ANCHORS, FIRST = 1024, 512, 8
PRODUCTS = 2**20
#: Squared norms up to this leave 100 times an inner product within a long.
LARGEST = 2.0**56
NONE = -(2**62)


@dataclass(frozen=True)
class Lists:
    """The index: centroids and radii, and the parts of the lists (cluster, ids, labels, vectors)."""

    centroids: np.ndarray
    radii: np.ndarray
    parts: DataFrame


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, label, vector: rows that take part, the vector as 32-bit whole numbers, padded with zeros to the longest."""
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(finite)
    scaled = known.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("double")))
    within = scaled.filter(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x) <= LARGEST)
    width = within.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            out = np.zeros((batch.num_rows, width), "<i4")
            lengths = np.diff(lists.offsets.to_numpy())
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out[np.repeat(np.arange(len(lengths)), lengths), place] = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in out], pa.binary())], names=["id", "label", "vector"])

    return stored(bounded_batches(within).select(F.col("id").cast("long"), F.col("label").cast("long"), "vector").mapInArrow(pack, "id long, label long, vector binary"), "vectors")


def matrix_of(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), -1)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def k_means(x: np.ndarray, k: int, turns: int = TURNS, seed: int = 0) -> np.ndarray:
    """At most ``k`` centroids of different rows of ``x``."""
    different = np.unique(x, axis=0).astype(float)
    c = different[np.random.default_rng(seed).permutation(len(different))[:k]]
    x = x.astype(float)
    for _ in range(turns):
        own = np.concatenate([distances(x[a : a + PART], c).argmin(1) for a in range(0, len(x), PART)])
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def inverted_lists(rows: DataFrame, part: int = PART) -> Lists | None:
    """The index over all ``rows`` (whole_vectors); its centroids come from about SAMPLE different rows, by hash, or all if there are fewer. None without rows."""
    n = rows.count()
    if not n:
        return None
    thin = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(2**40)) < int(2**40 * min(1.0, SAMPLE / n))
    sample = rows.filter(thin).distinct().orderBy("id", "label", "vector").collect()
    centroids = k_means(matrix_of([r["vector"] for r in sample]), min(CENTROIDS, round(n**0.5)))
    shipped = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PART):
                some = batch.slice(a, PART)
                x = matrix_of(some.column(2).to_pylist()).astype(float)
                own = distances(x, shipped.value).argmin(1)
                far = np.sqrt(((x - shipped.value[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(far), *some.columns], names=["cluster", "far", "id", "label", "vector"])

    assigned = stored(rows.mapInArrow(assign, "cluster int, far double, id long, label long, vector binary"), "assigned")
    radii, parts = np.full(len(centroids), -np.inf), np.ones(len(centroids), np.int64)
    for r in assigned.groupBy("cluster").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect():
        radii[r["cluster"]], parts[r["cluster"]] = r["r"], -(-r["n"] // part)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            one = [table["cluster"][0].as_py(), *(np.array(table[c].to_pylist(), "<i8").tobytes() for c in ("id", "label")), b"".join(table["vector"].to_pylist())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["cluster", "ids", "labels", "vectors"])

        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            edges = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0), True]) if batch.num_rows else []
            for a, b in zip(edges[:-1], edges[1:]):
                if held and (held[0].column(0)[0], held[0].column(1)[0]) != (batch.column(0)[int(a)], batch.column(1)[int(a)]):
                    yield packed()
                    held = []
                held.append(batch.slice(int(a), int(b - a)))
        if held:
            yield packed()

    of = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("cluster") + 1)
    dealt = assigned.select("cluster", F.pmod(F.monotonically_increasing_id(), of).cast("int").alias("part"), "id", "label", "vector")
    lists = dealt.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "id").mapInArrow(pack, "cluster int, ids binary, labels binary, vectors binary")
    return Lists(centroids, radii, stored(lists, "lists"))


def bounds(q: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``q`` with any row of each list; a hair wider than Cauchy-Schwarz for rounding. An empty list has none."""
    middle = q @ lists.centroids.T
    norm = np.sqrt((q * q).sum(1))[:, None]
    wide = norm * lists.radii + 0.5 + 1e-9 * (np.abs(middle) + norm * np.maximum(lists.radii, 0))
    return middle - wide, np.where(lists.radii >= 0, middle + wide, -np.inf)


def to_visit(q: np.ndarray, needs: np.ndarray, lists: Lists, first: int, later: bool) -> np.ndarray:
    """Whether each anchor visits each list, now or in the later turn. needs: anchors by windows by (low, high, kth score so far)."""
    least, most = bounds(q, lists)
    touched = np.zeros(least.shape, bool)
    open_ = np.zeros(least.shape, bool)
    for low, high, kth in needs.transpose(1, 2, 0)[:, :, :, None]:
        inside = (most >= low) & (least <= high) & (low <= high)
        touched |= inside
        open_ |= inside & (most >= kth)
    early = np.zeros(least.shape, bool)
    best = np.argsort(np.where(touched, -most, np.inf), axis=1, kind="stable")[:, :first]
    np.put_along_axis(early, best, True, axis=1)
    return open_ & ~early if later else touched & early


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can leave their whole numbers, else in 64-bit integers."""
    largest = np.sqrt((q.astype(float) ** 2).sum(1).max(initial=0) * (x.astype(float) ** 2).sum(1).max(initial=0))
    return (q.astype(float) @ x.astype(float).T).astype(np.int64) if largest < 2**52 else q.astype(np.int64) @ x.astype(np.int64).T


def best_of(scores: np.ndarray, ids: np.ndarray, needs: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Anchors, window, scores and ids of the first ``k`` in each window by score, then id; columns are in the order of ids, NONE is no candidate."""
    order = np.argsort(-scores, axis=1, kind="stable")
    ordered = np.take_along_axis(scores, order, 1)
    for p in range(needs.shape[1]):
        low, high, kth = needs[:, p].T
        at = (scores > high[:, None]).sum(1)[:, None] + np.arange(k)
        there = at < scores.shape[1]
        at = np.minimum(at, scores.shape[1] - 1)
        value = np.take_along_axis(ordered, at, 1)
        row, col = np.nonzero(there & (value > NONE) & (value >= np.maximum(low, kth)[:, None]))
        yield row, p, value[row, col], ids[order[row, at[row, col]]]


FOUND = "anchor long, mark long, window int, score long, other long"


def searched(anchors: DataFrame, lists: Lists, windows: int, k: int, same: bool, first: int, later: bool) -> DataFrame:
    """FOUND: candidates from the lists visited in this turn, the first ``k`` of a part in each window. anchors: id, mark, label, vector, needs (low, high, kth of each window)."""
    spark = anchors.sparkSession
    shipped = spark.sparkContext.broadcast(Lists(lists.centroids, lists.radii, None))
    visit_schema = pa.schema([("cluster", pa.int32()), ("keys", pa.binary()), ("vectors_a", pa.binary()), ("needs", pa.binary())])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ANCHORS):
                some = batch.slice(a, ANCHORS)
                keys = np.stack([np.array(some.column(i).to_pylist(), "<i8") for i in range(3)], 1)
                vectors = matrix_of(some.column(3).to_pylist())
                needs = np.array(some.column(4).to_pylist(), "<i8").reshape(len(keys), windows, 3)
                wanted = to_visit(vectors.astype(float), needs, shipped.value, first, later)
                rows = [(c, keys[m].tobytes(), vectors[m].tobytes(), needs[m].tobytes()) for c in np.flatnonzero(wanted.any(0)).tolist() for m in [wanted[:, c]]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(visit_schema)], schema=visit_schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, vectors, needs, ids, labels, own in zip(*(c.to_pylist() for c in batch.columns)):
                keys, ids, labels = np.frombuffer(keys, "<i8").reshape(-1, 3), np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                q, x = np.frombuffer(vectors, "<i4").reshape(len(keys), -1), np.frombuffer(own, "<i4").reshape(len(ids), -1)
                needs = np.frombuffer(needs, "<i8").reshape(len(keys), windows, 3)
                step = max(1, PRODUCTS // len(ids))
                out: list[tuple] = []
                for a in range(0, len(keys), step):
                    key = keys[a : a + step]
                    alike = labels == key[:, 2:]
                    may = (alike if same else ~alike) & (ids != key[:, :1])
                    for row, p, value, other in best_of(np.where(may, products(q[a : a + step], x), NONE), ids, needs[a : a + step], k):
                        out.append((key[row, 0], key[row, 1], np.full(len(row), p), value, other))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)], names=["anchor", "mark", "window", "score", "other"])

    packed = anchors.select("id", "mark", "label", "vector", "needs").mapInArrow(visits, "cluster int, keys binary, vectors_a binary, needs binary")
    # Spark can't know how large either side gets, so neither may be broadcast
    return packed.hint("merge").join(lists.parts, "cluster").select("keys", "vectors_a", "needs", "ids", "labels", "vectors").mapInArrow(score, FOUND)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and window with their turn; Spark drops others in each task before it shuffles."""
    turn = F.row_number().over(Window.partitionBy("anchor", "mark", "window").orderBy(F.desc("score"), "other"))
    return found.withColumn("turn", turn).filter(F.col("turn") <= k)


def best(anchors: DataFrame, lists: Lists, windows: int, k: int, same: bool, first: int = FIRST) -> DataFrame:
    """FOUND and turn: each anchor's first ``k`` in each window, exactly. anchors: id, mark, label, vector, windows (low, high of each)."""

    def needing(kth: list[Column]) -> Column:
        at = lambda i: F.element_at("windows", i + 1)
        return F.concat(*(F.array(at(2 * p), at(2 * p + 1), kth[p]) for p in range(windows)))

    early = stored(first_of(searched(anchors.withColumn("needs", needing([F.element_at("windows", 2 * p + 1) for p in range(windows)])), lists, windows, k, same, first, False), k), "first-visits")
    # the kth score found so far, where there are k
    last = early.filter(F.col("turn") == k).groupBy("anchor", "mark").agg(*(F.max(F.when(F.col("window") == p, F.col("score"))).alias(f"k{p}") for p in range(windows)))
    known = anchors.join(last.withColumnsRenamed({"anchor": "id"}), ["id", "mark"], "left")
    rest = known.withColumn("needs", needing([F.coalesce(f"k{p}", F.lit(NONE)) for p in range(windows)]))
    late = searched(rest, lists, windows, k, same, first, True)
    return stored(first_of(early.drop("turn").unionByName(late), k), "visits")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``rows`` (id, label, vector).

    Components are rounded down after multiplication by ``scale``; a score is an inner product of such vectors, exact.
    Anchors are the rows where ``anchor`` (a condition on id) holds. Each has as positives its first ``positives`` rows of
    its label, by score, then by smaller id; and for each of these the first ``negatives`` rows of other labels whose
    score is at least ``least`` and at most ``most`` hundredths of the positive's. Where there are fewer, all.

    Rows with a null id, label or vector or a component that is null or not finite take no part, nor do those whose
    scaled vector has a squared norm above LARGEST, whose scores a long may not hold. Shorter vectors count as padded
    with zeros; an empty one scores 0. Rows that repeat an id are candidates each; an anchor that repeats wholly counts
    once, and a row with the anchor's id isn't among its own positives or negatives. Other columns aren't read. An
    empty table gives none.
    """
    whole = whole_vectors(rows.select("id", "label", "vector"), scale)
    lists = inverted_lists(whole)
    if lists is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = stored(whole.filter(anchor).distinct().withColumn("mark", F.xxhash64("label", "vector")).withColumn("windows", F.array(F.lit(NONE), F.lit(-NONE))), "anchors")
    near = best(anchors, lists, 1, positives, same=True).select("anchor", "mark", (F.col("turn") - 1).alias("window"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    low, high = (F.expr(f"({x} - pmod({x}, 100)) div 100") for x in (f"({least} * positive_score + 99)", f"({most} * positive_score)"))
    none = F.array(F.lit(-NONE), F.lit(NONE))
    by_turn = F.map_from_entries(F.collect_list(F.struct("window", F.array(low, high))))
    windows = near.groupBy(F.col("anchor").alias("id"), "mark").agg(by_turn.alias("by"))
    windows = windows.select("id", "mark", F.concat(*(F.coalesce(F.try_element_at("by", F.lit(p)), none) for p in range(positives))).alias("windows"))
    far = best(anchors.drop("windows").join(windows, ["id", "mark"]), lists, positives, negatives, same=False)
    return far.join(near, ["anchor", "mark", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("turn").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 50 == 0)


ORACLE = f"""
WITH rows AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.id AS anchor_id, a.label = b.label AS same, b.id AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.id % 50 = 0 AND b.id <> a.id),
positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score
    FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
