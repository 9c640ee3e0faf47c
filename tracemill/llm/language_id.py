"""Language identification of words and spans, and from them of documents.

Counts of byte trigrams in words and of letters by script, per language, are summed over all training documents into
tables of fixed size. A word's script narrows the candidate languages; its trigrams score them. Viterbi decoding with a
penalty for switching labels every word of a text, so that mixed texts fall into spans.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, by_slices, documents, text_bytes

CELLS = 2**16
SWITCH = 15.0
SMOOTH = 0.5
OTHER_SCRIPT = 0.001  # a language is a candidate for a script that at least this share of its letters has
REMEMBERED = 200_000
UNKNOWN = "und"

# Unicode ranges of scripts, by first code point.
SCRIPTS = ((0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"))
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

# ASCII letters in lower case and all bytes of other characters stay; the rest separates words.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all trigrams of the words, a space before and after each, and at which of them each word begins."""
    data = np.frombuffer(b"  " + b"  ".join(words) + b"  ", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    x = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
    begins = 1 + np.r_[0, np.cumsum(sizes + 2)[:-1]]
    owner = np.zeros(len(data) - 1, bool)
    at = np.repeat(begins, sizes) + np.arange(sizes.sum()) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    owner[at] = True
    return x[at].astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]]


def script_of(word: bytes) -> int:
    """The script of most of a word's letters."""
    if word.isascii():
        return SCRIPT_NAMES.index("Latin")
    points = np.array([ord(c) for c in word.decode("utf-8", "replace")])
    return int(np.bincount(_SCRIPT_OF[np.searchsorted(_STARTS, points, side="right") - 1]).argmax())


def has_letter(text: bytes, words: list[bytes]) -> bool:
    return any(w[0] < 128 for w in words) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass(frozen=True)
class Languages:
    names: list[str]
    log_share: np.ndarray  # cell x language
    fits: np.ndarray  # script x language: candidate or not


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The words of each language's texts, a slice of a batch at a time."""
    for batch in batches:
        for a, b in by_slices(batch, 1):
            words: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()):
                words.setdefault(lang, []).extend(words_of(text))
            yield from ((k, v) for k, v in words.items() if v)


def learned(docs: DataFrame) -> Languages | None:
    """From all rows that have a text and a language and aren't held out; None if there are none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for lang, words in by_language(batches):
            if lang not in cells:
                cells[lang], scripts[lang] = np.zeros(CELLS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)
            cells[lang] += np.bincount(trigrams(words)[0], minlength=CELLS)
            for w, n in Counter(words).items():
                scripts[lang][script_of(w)] += n
        out = [(k, zlib.compress(cells[k].astype("<i8").tobytes(), 1), scripts[k].tolist()) for k in cells]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], names=["lang", "cells", "scripts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in pdf["cells"])
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "cells": [zlib.compress(total.tobytes(), 1)], "scripts": [sum(np.array(x) for x in pdf["scripts"]).tolist()]})

    schema = "lang string, cells binary, scripts array<long>"
    training = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    # tasks' tables are added in two steps, so no task holds those of all
    some = training.select("lang", text_bytes()).mapInArrow(count, schema).groupBy("lang", F.pmod(F.xxhash64("cells"), F.lit(256))).applyInPandas(add, schema)
    rows = sorted(some.groupBy("lang").applyInPandas(add, schema).collect(), key=lambda r: r["lang"])
    if not rows:
        return None
    counts = np.array([np.frombuffer(zlib.decompress(r["cells"]), "<i8") for r in rows], float).T + SMOOTH
    scripts = np.array([r["scripts"] for r in rows], float).T
    fits = scripts >= OTHER_SCRIPT * np.maximum(1, scripts.sum(axis=0))
    fits[~fits.any(axis=1)] = True  # a script that no language has leaves all
    return Languages([r["lang"] for r in rows], np.log(counts / counts.sum(axis=0)).astype(np.float32), fits)


class Labeller:
    """Labels words; remembers the scores of a bounded number of different ones."""

    def __init__(self, languages: Languages, switch: float = SWITCH):
        self.languages, self.switch = languages, switch
        self.places: dict[bytes, int] = {}
        self.scores = np.zeros((0, len(languages.names)), np.float32)

    def prepare(self, words: set[bytes]) -> None:
        missing = list(words.difference(self.places))
        if not missing:
            return
        if len(self.places) > REMEMBERED:
            self.places, self.scores, missing = {}, self.scores[:0], list(words)
        cells, begins = trigrams(missing)
        new = np.add.reduceat(self.languages.log_share[cells], begins, axis=0)
        new[~self.languages.fits[np.fromiter(map(script_of, missing), np.int64, len(missing))]] = -1e4
        self.places.update(zip(missing, range(len(self.scores), len(self.scores) + len(missing))))
        self.scores = np.concatenate([self.scores, new])

    def path(self, words: list[bytes]) -> np.ndarray:
        """The language of each word on the best path."""
        scores = self.scores[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))].astype(float)
        best = int(scores.sum(axis=0).argmax())
        # a stretch in other languages has more switches than languages, so none pays off if no language gains a penalty anywhere
        gains = np.cumsum(scores - scores[:, [best]], axis=0)
        lowest = np.minimum.accumulate(np.vstack([np.zeros(scores.shape[1]), gains[:-1]]), axis=0)
        if (gains - lowest).max() <= self.switch:
            return np.full(len(words), best)
        return viterbi(scores, self.switch)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    n, states = scores.shape
    back = np.zeros((n, states), np.int64)
    stay = np.arange(states)
    total = scores[0].copy()
    for t in range(1, n):
        top = int(total.argmax())
        jump = total[top] - switch
        back[t] = np.where(total >= jump, stay, top)
        total = np.maximum(total, jump) + scores[t]
    path = np.zeros(n, np.int64)
    path[-1] = int(total.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


RESULT = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,words:int>>"


def identified(docs: DataFrame, languages: Languages | None) -> DataFrame:
    """RESULT for every row: the language of most letters and their share; spans: languages in turn with their numbers of words.

    A null text, or one without letters, is ``und`` with score 0 and has no spans; so is any text if nothing was learned.
    Repeated rows are judged each, long texts whole; an empty table gives none.
    """
    shipped = bounded_batches(docs).sparkSession.sparkContext.broadcast(languages)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())])))])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Languages | None = shipped.value
        labeller = Labeller(known) if known else None
        for batch in batches:
            for a, b in by_slices(batch, 1):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                split = [words_of(t) for t in texts]
                if labeller:
                    labeller.prepare(set().union(*split))
                out = []
                for text, words in zip(texts, split):
                    if not labeller or not words or not has_letter(text, words):
                        out.append((UNKNOWN, 0.0, []))
                        continue
                    path = labeller.path(words)
                    letters = np.bincount(path, weights=np.fromiter(map(len, words), np.int64, len(words)), minlength=len(known.names))
                    edges = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
                    out.append((known.names[int(letters.argmax())], float(letters.max() / letters.sum()), [{"lang": known.names[path[i]], "words": int(j - i)} for i, j in zip(edges[:-1], edges[1:])]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array([r[k] for r in out], f.type) for k, f in enumerate(list(schema)[1:]))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(label, RESULT)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identified(docs, learned(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
