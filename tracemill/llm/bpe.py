"""BPE encoding and decoding with a contiguous rank array.

A short word keeps its parts and the ranks of neighbouring parts in two rows of contiguous memory. Again and again the
row is scanned for its least rank, the boundary there is deleted and the ranks beside it are looked up anew. Words of
similar length are worked on together, a word a row. Longer words use a heap, so that no word costs more than
n log n. Each task keeps what it has encoded, by chunk between white space, in dictionaries of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import bounded_batches, by_slices, documents, text_bytes

WIDTHS = (8, 16, 32, 64)
NO_RANK = np.int32(2**31 - 1)
REMEMBERED = 250_000
APART = re.compile(rb"(?<=[a-zA-Z])([.,])(?=[\x20\n]|\Z)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the others counted up from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def is_word(chunk: bytes) -> bool:
    """Whether a chunk is letters only and as the normalizer would leave it."""
    if chunk.isascii():
        return chunk.isalpha() and chunk.islower()
    text = chunk.decode("utf-8", "replace")
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


class WordBpe:
    """A tokenizer file's BPE with word ends: NFC, white space, lower case, its split pattern, bytes as letters.

    ``encode`` gives a text's ids as the public library does without truncation, padding or added specials. The special
    tokens' strings in a text become their ids. A null or empty text has no ids.
    """

    def __init__(self, file: str):
        spec = json.loads(file)
        model, self.specials = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.tokens = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.old = self.chunks

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.ranks[at], NO_RANK)

    def merge_short(self, words: list[bytes], width: int) -> list[bytes]:
        """The ids of words of at most ``width`` bytes, as little-endian 32-bit numbers."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        places = np.arange(width)
        parts = np.where(places < sizes[:, None], self.first[raw], -1).astype(np.int32)
        every = np.arange(n)
        parts[every, sizes - 1] = self.last[raw[every, sizes - 1]]
        ranks = np.full((n, width), NO_RANK, np.int32)
        ranks[:, :-1] = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        out, rows, sizes_left = np.full((n, width), -1, np.int32), every, sizes
        while len(rows):
            least = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), least]
            done = best == NO_RANK
            if done.any():
                out[rows[done]] = parts[done]
                sizes[rows[done]] = sizes_left[done]
                go = ~done
                rows, parts, ranks, least, best, sizes_left = rows[go], parts[go], ranks[go], least[go], best[go], sizes_left[go]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            parts[at, least] = self.merged[best]
            closer = np.minimum(places + (places > least[:, None]), width - 1)
            parts = np.take_along_axis(parts, closer, 1)
            parts[:, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(places + (places >= least[:, None]), width - 1), 1)
            ranks[:, -1] = NO_RANK
            sizes_left = sizes_left - 1
            after = np.minimum(least + 1, width - 1)
            ranks[at, least] = self.pair_ranks(parts[at, least], np.where(after > least, parts[at, after], -1))
            before = least > 0
            ranks[at[before], least[before] - 1] = self.pair_ranks(parts[at[before], least[before] - 1], parts[at[before], least[before]])
        data = out.astype("<u4").tobytes()
        return [data[i * 4 * width : i * 4 * width + 4 * s] for i, s in enumerate(sizes.tolist())]

    def merge_long(self, word: bytes) -> bytes:
        """The same for a word of any length: a heap of ranks over linked parts."""
        parts = self.first[np.frombuffer(word, np.uint8)].tolist()
        parts[-1] = int(self.last[word[-1]])
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank_of.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank_of.get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return array("I", [p for p in parts if p >= 0]).tobytes()

    def learn_words(self, words: Iterable[bytes]) -> None:
        by_width: dict[int, list[bytes]] = {}
        for word in words:
            by_width.setdefault(next((w for w in WIDTHS if len(word) <= w), 0), []).append(word)
        for width, some in by_width.items():
            self.words.update(zip(some, self.merge_short(some, width) if width else map(self.merge_long, some)))

    def split(self, chunk: bytes) -> list[bytes | int]:
        """A chunk's words and the ids of special tokens in it."""
        if chunk.isascii() and b"<|" not in chunk:
            return [w.encode() for w in self.pattern.findall(chunk.decode().lower())]
        out: list[bytes | int] = []
        text = chunk.decode("utf-8", "replace")
        for k, piece in enumerate(self.special_pattern.split(text) if self.special_pattern else [text]):
            if k % 2:
                out.append(self.specials[piece])
            elif piece:
                piece = "".join([c.lower() for c in unicodedata.normalize("NFC", piece)])
                out += [w.encode() for w in self.pattern.findall(piece)]
        return out

    def learn(self, chunks: Iterable[bytes]) -> None:
        """Fills ``self.chunks`` for all of ``chunks``. One that is a word of lower-case letters is taken as it is."""
        plain, others = [], []
        for c in chunks:
            (plain if is_word(c) else others).append(c)
        parts = [self.split(c) for c in others]
        self.words = {}
        self.learn_words({*plain, *(w for p in parts for w in p if isinstance(w, bytes))})
        for c in plain:
            self.chunks[c] = self.words[c]
        for c, p in zip(others, parts):
            self.chunks[c] = b"".join([self.words[w] if isinstance(w, bytes) else w.to_bytes(4, "little") for w in p])

    def chunked(self, text: bytes) -> list[bytes]:
        """A text at ASCII white space, without changing its tokens.

        A-Z are lower-cased here and a comma or full stop that stands between a letter and white space is set apart,
        so that fewer chunks differ. Neither is done where it could matter: special tokens' strings are not lower-cased
        before they are found, and letters may only join with a combining mark as they were written.
        """
        if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return APART.sub(b" \\1", text).split()

    def prepare(self, chunks: set[bytes]) -> None:
        """After this, ``ids`` knows all of ``chunks``. Two generations are kept: what is used again passes to the younger one."""
        if len(self.chunks) > REMEMBERED:
            self.age()
        missing = chunks.difference(self.chunks)
        again = [c for c in missing if c in self.old]
        for c in again:
            self.recall(c)
        self.learn(missing.difference(again))

    def age(self) -> None:
        self.old, self.chunks = self.chunks, {}

    def recall(self, chunk: bytes) -> None:
        self.chunks[chunk] = self.old[chunk]

    def ids(self, chunks: list[bytes]) -> bytes:
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: bytes) -> bytes:
        chunks = self.chunked(text)
        self.prepare({*chunks})
        return self.ids(chunks)


class Rendered(WordBpe):
    """Also keeps each chunk's ids in decimal and its decoded tokens."""

    def __init__(self, file: str):
        super().__init__(file)
        self.decimals: dict[bytes, str] = {}
        self.decoded: dict[bytes, str] = {}
        self.older = self.decimals, self.decoded
        self.as_decimal = [str(i) for i in range(len(self.tokens))]

    def age(self) -> None:
        super().age()
        self.older = self.decimals, self.decoded
        self.decimals, self.decoded = {}, {}

    def recall(self, chunk: bytes) -> None:
        super().recall(chunk)
        self.decimals[chunk], self.decoded[chunk] = self.older[0][chunk], self.older[1][chunk]

    def learn(self, chunks: Iterable[bytes]) -> None:
        chunks = list(chunks)
        super().learn(chunks)
        for chunk in chunks:
            ids = array("I", self.chunks[chunk])
            self.decimals[chunk] = " ".join([self.as_decimal[i] for i in ids])
            self.decoded[chunk] = self.decode(ids)

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])

    def render(self, chunks: list[bytes]) -> tuple[str, str]:
        return " ".join(filter(None, map(self.decimals.__getitem__, chunks))), " ".join(filter(None, map(self.decoded.__getitem__, chunks)))


_LOADED: dict[tuple[type, int], WordBpe] = {}


def loaded(kind: type[WordBpe], file) -> WordBpe:
    """One coder a worker, kept from task to task with what it remembers."""
    key = (kind, hash(file.value))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = kind(file.value)
    return _LOADED[key]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The text of a public tokenizer's file, read once by the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def per_text(docs: DataFrame, kind: type[WordBpe], file: str, schema: str, arrow: pa.Schema, rows: Callable[[WordBpe, object, list[bytes]], Iterable[tuple]]) -> DataFrame:
    """What ``rows`` makes of each row's doc_id and text, in chunks: no word reaches across them."""
    shipped = docs.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(kind, shipped)
        for batch in batches:
            for a, b in by_slices(batch, 1):
                ids, texts = batch.column(0).slice(a, b - a).to_pylist(), [coder.chunked(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                coder.prepare(set().union(*texts))
                out = [row for i, chunks in zip(ids, texts) for row in rows(coder, i, chunks)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return bounded_batches(docs).select("doc_id", text_bytes().alias("text")).mapInArrow(run, schema)


def _encoded_row(coder: Rendered, doc_id, chunks: list[bytes]) -> Iterator[tuple]:
    ids, decoded = coder.render(chunks)
    yield doc_id, ids.count(" ") + 1 if ids else 0, ids, decoded


def _digest_row(coder: Rendered, doc_id, chunks: list[bytes]) -> Iterator[tuple]:
    ids, decoded = coder.render(chunks)
    yield doc_id, ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encoded(docs: DataFrame, file: str) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_tokens, ids (decimal, joined by spaces), decoded text. Null text: no ids. Repeated rows are encoded each, long texts whole; an empty table gives none."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])
    return per_text(docs, Rendered, file, "doc_id long, n_tokens long, ids string, decoded string", arrow, _encoded_row)


def encoding_digests(docs: DataFrame, file: str) -> DataFrame:
    """The same with SHA-256 digests in place of ids and decoded text, so that neither leaves its task."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return per_text(docs, Rendered, file, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", arrow, _digest_row)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir), tokenizer_file())
