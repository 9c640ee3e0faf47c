"""Quality rules: counts, and labels of lines by a linear-chain conditional random field.

Each line of a text is content or boilerplate; Viterbi decoding finds the best labels of all lines together. A document
is kept if no base rule fails and at least half of its words are in content lines.

Only documents have labels, and only a bounded sample of them is used. Labels of its lines come from evidence within and
across documents: a line that repeats in its text, or stands among different lines in many texts (``frequent_lines``),
is boilerplate; of other lines a logistic regression on documents' labels says which look like the lines of the other
class: prose in a bad document is content, junk in a good one is not. The field is fitted to these labels; then lines
are labelled by the field itself, leaning towards their document's label, and it is fitted again.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import logistic, logits, sigmoid
from .shared import bounded_batches, by_slices, documents, text_bytes
from .shingles import ODD, mixed, word_hashes

LABELLED, SEGMENTS, SEGMENT = 3000, 6000, 64
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
CONTENT_SHARE = 0.5
ROUNDS, LEAN, SURE = 2, 1.0, 0.75
LEAST_CONTEXTS, CONTEXT_SHARE, MOST_FREQUENT = 8, 0.005, 4096
_SYMBOLS = b"#*$%&|<>"
_CONTINUED_OR_SPACE = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
FEATURES = 10
REPEATED, FREQUENT = 7, 9


def line_features(line: bytes, words: list[bytes], seen: set[bytes], frequent: frozenset[int]) -> tuple:
    size, n = max(1, len(line)), len(words)
    letters = max(1, len(line.translate(None, _NOT_LETTER)))
    again = sum(map(operator.eq, words[1:], words))
    return (1.0, 10 * (len(line) - len(line.translate(None, _SYMBOLS))) / size, 10 * line.count(b"!") / size, 2 * len(line.translate(None, _NOT_UPPER)) / letters, 3 * again / max(1, n), np.log1p(n) / 3, float(line.rstrip().endswith((b".", b"?", b'"'))), float(line in seen), 5 * sum(line.count(c) for c in b"0123456789") / size if n < 40 else 0.0, float(line_hash(line) in frequent))


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def described(text: bytes, frequent: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and numbers of words of the lines with a word, and how many of these equal an earlier line."""
    seen: set[bytes] = set()
    rows, sizes, repeats = [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            rows.append(line_features(line, words, seen, frequent))
            sizes.append(len(words))
            repeats += line in seen
            seen.add(line)
    return np.array(rows, np.float32).reshape(len(rows), FEATURES), np.array(sizes, np.int64), repeats


@dataclass(frozen=True)
class Field:
    """Weights of features by label (boilerplate, content) and of neighbouring labels."""

    emit: np.ndarray
    move: np.ndarray
    frequent: frozenset[int] = frozenset()

    def labels(self, x: np.ndarray, lean: float = 0.0) -> np.ndarray:
        """The best labels of all lines together, content being worth ``lean`` more."""
        a, b = (x @ self.emit + [0.0, lean]).T.tolist()
        (stay0, to1), (to0, stay1) = self.move.tolist()
        back, s0, s1 = [], a[0], b[0]
        for e0, e1 in zip(a[1:], b[1:]):
            from0, from1 = s1 + to0 > s0 + stay0, s1 + stay1 >= s0 + to1
            back.append((from0, from1))
            s0, s1 = (s1 + to0 if from0 else s0 + stay0) + e0, (s1 + stay1 if from1 else s0 + to1) + e1
        out = [s1 >= s0]
        for from0, from1 in reversed(back):
            out.append(from1 if out[-1] else from0)
        return np.array(out[::-1], bool)


Group = tuple[np.ndarray, ...]


def by_length(segments: list[np.ndarray], labels: list[np.ndarray]) -> tuple[list[Group], float]:
    """Features, mask, labels, weights and label pairs of segments of about equal length each, so that little is padding; and the number of lines."""
    counts = np.bincount(np.concatenate(labels).astype(int), minlength=2)
    own = 0.5 * counts.sum() / np.maximum(1, counts)  # both labels count alike
    wanted: dict[int, list[int]] = {}
    for k, s in enumerate(segments):
        wanted.setdefault((len(s) - 1).bit_length(), []).append(k)
    groups = []
    for some in wanted.values():
        n, longest = len(some), max(len(segments[k]) for k in some)
        x, mask, gold = np.zeros((n, longest, FEATURES)), np.zeros((n, longest)), np.zeros((n, longest, 2))
        for i, k in enumerate(some):
            size = len(segments[k])
            x[i, :size], mask[i, :size] = segments[k], 1
            gold[i, np.arange(size), labels[k].astype(int)] = 1
        groups.append((x, mask, gold, gold @ own, np.einsum("ntl,ntm->ntlm", gold[:, :-1], gold[:, 1:])))
    return groups, float(counts.sum())


def gradient(group: Group, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Of the weighted log-likelihood of a group's labels, by the forward-backward recursion over all its segments at once."""
    x, mask, gold, weight, seen = group
    n, longest = mask.shape
    score = x @ emit
    forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    forward[:, 0] = score[:, 0]
    for t in range(1, longest):
        forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + move[0], forward[:, t - 1, 1:] + move[1]) + score[:, t]
    for t in range(longest - 2, -1, -1):
        ahead = backward[:, t + 1] + score[:, t + 1]
        onward = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
        backward[:, t] = np.where(mask[:, t + 1, None] > 0, onward, 0)
    total = forward + backward
    total -= np.logaddexp(total[..., :1], total[..., 1:])
    of_emit = np.tensordot(x, (gold - np.exp(total)) * weight[..., None], axes=((0, 1), (0, 1)))
    pair = forward[:, :-1, :, None] + move + (score + backward)[:, 1:, None, :]
    pair = np.exp(pair - pair.max(axis=(2, 3), keepdims=True))
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    of_move = ((seen - pair) * weight[:, 1:, None, None]).sum(axis=(0, 1))
    return np.r_[of_emit.ravel(), of_move.ravel()]


def fit_field(segments: list[np.ndarray], labels: list[np.ndarray]) -> Field:
    """Maximum likelihood of the labels (1: content) with a ridge, by Adam."""
    groups, lines = by_length(segments, labels)
    theta = np.zeros(2 * FEATURES + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        emit, move = theta[: 2 * FEATURES].reshape(FEATURES, 2), theta[2 * FEATURES :].reshape(2, 2)
        grad = sum(gradient(g, emit, move) for g in groups) / lines - RIDGE * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta += RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(theta[: 2 * FEATURES].reshape(FEATURES, 2), theta[2 * FEATURES :].reshape(2, 2))


def frequent_lines(documents: list[np.ndarray]) -> frozenset[int]:
    """Hashes of at most MOST_FREQUENT lines that stand between different neighbours in many documents of the sample. Copies of one document, however many, have the same neighbours."""
    contexts = set()
    for lines in documents:
        around = [0, *lines.tolist(), 0]
        contexts.update(zip(around[1:-1], around, around[2:]))
    counts = Counter(line for line, _, _ in contexts)
    least = max(LEAST_CONTEXTS, CONTEXT_SHARE * len(documents))
    return frozenset(line for line, n in counts.most_common(MOST_FREQUENT) if n >= least)


def first_labels(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Labels of lines from their features and their documents' labels."""
    known = (x[:, REPEATED] > 0) | (x[:, FREQUENT] > 0)
    some = x[~known]
    # bad documents are fewer: a line's odds are taken without their share
    odds = logits(some[:, 1:], logistic(some[:, 1:], good[~known].astype(float))) - np.log(max(1, good[~known].sum()) / max(1, (~good[~known]).sum()))
    p, own = sigmoid(odds), np.zeros(len(x), bool)
    own[~known] = np.where(good[~known], p > 1 - SURE, p >= SURE)
    return own


def fitted(docs: DataFrame, labels: DataFrame) -> Field | None:
    """From at most LABELLED labelled documents, cut into segments of SEGMENT lines, at most SEGMENTS of them; None unless both labels occur."""
    order = F.xxhash64("doc_id")
    chosen = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(order, "doc_id").limit(LABELLED)
    schema = "doc_id long, quality int, part int, lines binary, hashes binary"
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, quality, text in zip(*(c.to_pylist() for c in batch.columns)):
                x = described(text)[0]
                h = np.array([line_hash(line) for line in text.split(b"\n") if line.split()], np.uint64)
                rows += [(i, quality, k, x[k : k + SEGMENT].astype("<f4").tobytes(), h[k : k + SEGMENT].tobytes()) for k in range(0, len(x), SEGMENT)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "quality", "part", "lines", "hashes"])

    taken = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = taken.mapInArrow(describe, schema).orderBy(F.xxhash64("doc_id", "part"), "doc_id", "part").limit(SEGMENTS).collect()
    if len({r["quality"] for r in rows}) < 2:
        return None
    segments = [np.frombuffer(r["lines"], "<f4").reshape(-1, FEATURES).copy() for r in rows]
    hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    frequent = frequent_lines(hashes)
    for s, h in zip(segments, hashes):
        s[:, FREQUENT] = [v in frequent for v in h.tolist()]
    good = [bool(r["quality"]) for r in rows]
    return with_line_labels(segments, good, frequent)


def with_line_labels(segments: list[np.ndarray], good: list[bool], frequent: frozenset[int]) -> Field:
    """Alternates labels of lines and the field that is fitted to them."""
    edges = np.cumsum([len(s) for s in segments])[:-1]
    own = np.split(first_labels(np.concatenate(segments).astype(float), np.repeat(good, [len(s) for s in segments])), edges)
    field = fit_field(segments, own)
    for _ in range(ROUNDS - 1):
        # repeated and frequent lines stay boilerplate
        own = [field.labels(s, LEAN if g else -LEAN) & (s[:, REPEATED] == 0) & (s[:, FREQUENT] == 0) for s, g in zip(segments, good)]
        field = fit_field(segments, own)
    return Field(field.emit, field.move, frequent)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    h = word_hashes(words)
    window = mixed(h[:-2] * ODD[0] + h[1:-1] * ODD[1] + h[2:] * ODD[2])
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judged(docs: DataFrame, field: Field | None) -> DataFrame:
    """RESULT for every row, repeated ones each. A null text has no words, and so fails; long texts are read whole. Without a field, the base rules decide. content_share: words in content lines among all, null without words or field. An empty table gives none."""
    shipped = bounded_batches(docs).sparkSession.sparkContext.broadcast(field)
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.float64()]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Field | None = shipped.value
        for batch in batches:
            for a, b in by_slices(batch, 1):
                out = []
                for i, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()):
                    words = text.split()
                    repeats = repeated_words(words)
                    x, sizes, same = described(text, known.frequent if known else frozenset())
                    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
                    share = float(sizes[known.labels(x)].sum() / sizes.sum()) if known and len(x) else None
                    out.append((i, len(words), len(text.translate(None, _CONTINUED_OR_SPACE)), len(text) - len(text.translate(None, _SYMBOLS)), same, repeats, failed, not failed and (share is None or share >= CONTENT_SHARE), share))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(judge, RESULT)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judged(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
