"""A quality classifier by co-training.

One classifier sees a text's content, the other its page's metadata only: source, language and recorded size. Both are
fitted to a bounded sample of labelled documents. Then they teach each other for some rounds: in each, every document
without a label (all of them, whatever their number) is scored by both views where its features are read; those of which
one view is certain are examples for the other. What is certain is settled on labelled documents held out: a view's scores
are calibrated there, and it teaches only if, of both classes, the documents it calls certain there are right
often enough; a view that knows nothing teaches nothing. Only sums come back: how many examples there are of each class, and the gradient
and curvature they add; each class counts at most as much as the labelled documents do, so the exchange weighs the same at every size. A
round is one step of Newton's method with the curvature of the labelled sample. On the documents held out the two views
are combined; the round with the least loss there is kept, the one before any exchange included. The combined model
scores every document where it is read.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import logistic, logits, sigmoid
from .shared import bounded_batches, documents, stored, unused_name
from .shingles import word_hashes

LABELLED = 4000
ROUNDS, CERTAIN = 4, 0.95
#: Documents held out that a view must be certain of before it teaches, and the loss that counts as equal.
LEAST_SURE, EQUAL = 5, 1e-4
SURE = float(np.log(CERTAIN / (1 - CERTAIN)))
RIDGE = 1.0
THRESHOLD = 0.5
BAG, META_CELLS = 256, 64
TEXT_SIZE, META_SIZE = 10 + BAG, 2 + META_CELLS
_UPPER, _DIGIT, _SYMBOL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>!"
_COUNTED = (_UPPER, _DIGIT, _SYMBOL, b"|", b"!", b".,")
INPUTS = ("text", "source", "lang", "n_chars")


def text_features(text: bytes) -> np.ndarray:
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    shares = [(len(text) - len(text.translate(None, c))) / size for c in _COUNTED]
    again = sum(map(operator.eq, words[1:], words)) / n
    out = np.zeros(len(shares) + 4 + BAG, np.float32)
    out[: len(shares) + 4] = [*(10 * x for x in shares), 5 * again, len({*words}) / n, size / n / 10, np.log1p(len(words)) / 10]
    if words:
        out[len(shares) + 4 :] = np.sqrt(np.bincount((word_hashes(words) & np.uint64(BAG - 1)).astype(np.int64), minlength=BAG) / n)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_SIZE, np.float32)
    out[:2] = [np.log1p(max(0, n_chars or 0)) / 10, float(n_chars is None)]
    for value in (f"s:{source}", f"l:{lang}"):
        out[2 + zlib.crc32(value.encode()) % META_CELLS] = 1
    return out


@dataclass(frozen=True)
class CoTrained:
    """Each view's weights, its calibration (slope, intercept) and the combination's weights."""

    views: tuple[np.ndarray, np.ndarray]
    calibration: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [logits(logits(x, w)[:, None], c) for x, w, c in zip((text, meta), self.views, self.calibration)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(logits(np.stack(z, 1), self.combined))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and views, the features of both views in 16 bits each, of every document: written once for all rounds."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                ids, *rest = (c.slice(a, 512).to_pylist() for c in batch.columns)
                rows = [np.r_[text_features(t), meta_features(*m)].astype("<f2").tobytes() for t, *m in zip(*rest)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "views"])

    return stored(docs.select(F.col("doc_id").cast("long"), *inputs(docs)).mapInArrow(describe, "doc_id long, views binary"), "views")


def views_of(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(rows), "<f2").astype(float).reshape(len(rows), TEXT_SIZE + META_SIZE)
    return x[:, :TEXT_SIZE], x[:, TEXT_SIZE:]


Marks = tuple[float, float]


def lessons(views: tuple[np.ndarray, np.ndarray], weights: list[np.ndarray], marks: tuple[Marks, Marks]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """View, class, number, gradient and curvature (of each feature and the intercept) of the documents of which the other view is certain: its score is at or beyond one of its marks."""
    raw = [logits(x, w) for x, w in zip(views, weights)]
    p = [sigmoid(z) for z in raw]
    for view in (0, 1):
        low, high = marks[1 - view]
        for kind, sure in ((0, raw[1 - view] <= low), (1, raw[1 - view] >= high)):
            x, error, bend = views[view][sure], kind - p[view][sure], (p[view] * (1 - p[view]))[sure]
            yield view, kind, int(sure.sum()), np.r_[error @ x, error.sum()], np.r_[bend @ x**2, bend.sum()]


def exchanged(pool: DataFrame, weights: list[np.ndarray], marks: tuple[Marks, Marks] = ((-SURE, SURE), (-SURE, SURE))) -> dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]]:
    """By view and class the number of documents that teach it, their gradient and curvature: sums over all of ``pool``."""
    shipped = pool.sparkSession.sparkContext.broadcast((weights, marks))
    schema = pa.schema([("view", pa.int32()), ("kind", pa.int32()), ("place", pa.int32()), ("value", pa.float64())])

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                for view, kind, n, gradient, bend in lessons(views_of(batch.column(0).slice(a, 2048).to_pylist()), *shipped.value):
                    sums[view, kind] = sums.get((view, kind), 0) + np.r_[n, gradient, bend]
        rows = [(*k, i, v) for k, total in sums.items() for i, v in enumerate(total.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    found = pool.select("views").mapInArrow(teach, "view int, kind int, place int, value double")
    sums = {(view, kind): np.zeros(1 + 2 * (size + 1)) for view, size in ((0, TEXT_SIZE), (1, META_SIZE)) for kind in (0, 1)}
    for r in found.groupBy("view", "kind", "place").agg(F.sum("value").alias("value")).collect():
        sums[r["view"], r["kind"]][r["place"]] = r["value"]
    return {k: (v[0], *np.split(v[1:], 2)) for k, v in sums.items()}


def certain(raw: np.ndarray, y: np.ndarray) -> Marks | None:
    """The scores from which a view is certain of a class, by its scores of documents held out and their classes; None unless it is right there about both."""
    slope, intercept = logistic(raw[:, None], y.astype(float))
    if slope <= 0:
        return None
    low, high = (-SURE - intercept) / slope, (SURE - intercept) / slope
    for kind, sure in ((0, raw <= low), (1, raw >= high)):
        if sure.sum() < LEAST_SURE or (y[sure] == kind).mean() < CERTAIN:
            return None
    return low, high


def taught(x: np.ndarray, y: np.ndarray, w: np.ndarray, lesson: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights after a step on the labelled documents and a lesson, each class of which counts as much as among the labelled."""
    full = np.hstack([x, np.ones((len(x), 1))])
    p = sigmoid(full @ w)
    shrink = np.r_[np.full(x.shape[1], RIDGE), 1e-6]
    gradient, bends = full.T @ (y - p) - shrink * w, shrink.copy()
    for kind, (n, own, bend) in lesson.items():
        share = min(1.0, (y == kind).sum() / n)
        gradient += own * share
        bends += bend * share
    # pseudo-labels double the mass, and so the curvature
    return w + np.linalg.solve(2 * (full * (p * (1 - p) + 1e-3)[:, None]).T @ full + np.diag(bends), gradient)


def combined(weights: list[np.ndarray], views: list[np.ndarray], y: np.ndarray) -> tuple[CoTrained, float]:
    """The model of both views' weights, calibrated and combined on documents held out, and its loss there."""
    judged = y.astype(float)
    calibration = tuple(logistic(logits(x, w)[:, None], judged) for x, w in zip(views, weights))
    z = np.stack([logits(logits(x, w)[:, None], c) for x, w, c in zip(views, weights, calibration)], 1)
    both = logistic(z, judged)
    p = np.clip(sigmoid(logits(z, both)), 1e-9, 1 - 1e-9)
    return CoTrained(tuple(weights), calibration, both), float(-np.mean(judged * np.log(p) + (1 - judged) * np.log(1 - p)))


def co_trained(text: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray, pool: DataFrame | None, rounds: int = ROUNDS) -> CoTrained:
    """The model of the round with the least loss on documents held out; of rounds as good as equal the last."""
    own = [(x[~held], y[~held].astype(float)) for x in (text, meta)]
    out = [x[held] for x in (text, meta)]
    weights = [logistic(*o) for o in own]
    model, least = combined(weights, out, y[held])
    for _ in range(rounds if pool is not None else 0):
        marks = [certain(logits(x, w), y[held]) for x, w in zip(out, weights)]
        if not any(marks):
            break
        found = exchanged(pool, weights, tuple(m or (-np.inf, np.inf) for m in marks))
        lesson = [{kind: found[v, kind] for kind in (0, 1)} for v in (0, 1)]
        # a view learns both classes or none
        learns = [all(n for n, *_ in lesson[v].values()) for v in (0, 1)]
        if not any(learns):
            break
        weights = [taught(*own[v], weights[v], lesson[v]) if learns[v] else weights[v] for v in (0, 1)]
        now, loss = combined(weights, out, y[held])
        if loss <= least + EQUAL:
            model, least = now, min(least, loss)
    return model


def fitted(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained | None:
    """From at most LABELLED labelled documents, the first by hash of doc_id, and all others. None unless both classes are among the sample's part to learn from and its part held out."""
    order = F.xxhash64("doc_id")
    chosen = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(order, "doc_id").limit(LABELLED)
    table = feature_table(docs)
    # rows that repeat a doc_id count once
    sample = table.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.max("views").alias("views")).orderBy("doc_id").collect()
    if not sample:
        return None
    y = np.array([r["quality"] for r in sample], np.int64)
    held = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 4 == 0 for r in sample], bool)
    if any(len({*y[part].tolist()}) < 2 for part in (held, ~held)):
        return None
    text, meta = views_of([r["views"] for r in sample])
    return co_trained(text, meta, y, held, table.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti"), rounds)


def inputs(docs: DataFrame) -> list[Column]:
    """INPUTS of ``docs``, nulls for those it lacks; a null text is empty."""
    text, *rest = (F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind) for c, kind in zip(INPUTS, ("string", "string", "string", "long")))
    return [F.coalesce(text, F.lit("")).cast("binary").alias("text"), *(c.alias(n) for c, n in zip(rest, INPUTS[1:]))]


def scorer(spark: SparkSession, model: CoTrained):
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<text:double,meta:double,both:double>")
    def score(text: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> pa.Array:
        out = []
        for a in range(0, len(text), 512):
            part = [c.slice(a, 512).to_pylist() for c in (text, source, lang, n_chars)]
            views = np.array([text_features(t) for t in part[0]]), np.array([meta_features(*r) for r in zip(*part[1:])])
            out.append(np.stack(shipped.value.score(*views), 1))
        scores = np.concatenate(out) if out else np.zeros((0, 3))
        return pa.StructArray.from_arrays([pa.array(scores[:, k]) for k in range(3)], names=["text", "meta", "both"])

    return score


def scored(docs: DataFrame, labels: DataFrame) -> Column:
    """A column for ``docs``: text, meta, both: each view's and the combined probability of good quality; nulls if there is nothing to learn from.

    A null text is empty, other nulls (a null doc_id too) are values of their own. Texts count whole, however long. Rows that repeat score alike.
    """
    model = fitted(bounded_batches(docs), labels)
    if model is None:
        return F.struct(*(F.lit(None).cast("double").alias(x) for x in ("text", "meta", "both")))
    return scorer(docs.sparkSession, model)(*inputs(docs))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose combined score reaches THRESHOLD, or all if there is nothing to learn from. An empty table gives an empty one."""
    own = unused_name(docs, "quality")
    return docs.withColumn(own, scored(docs, labels)["both"]).filter(F.coalesce(F.col(own), F.lit(1.0)) >= THRESHOLD).drop(own)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", *INPUTS)
    found = docs.select("doc_id", scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).alias("s"))
    return found.select("doc_id", F.col("s.text").alias("p_text"), F.col("s.meta").alias("p_meta"), F.col("s.both").alias("score"), (F.coalesce("s.both", F.lit(1.0)) >= THRESHOLD).alias("kept"))
