"""Word shingles of texts as 64-bit hashes, computed in batches of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

WIDTH = 5
REMEMBERED = 200_000
LONGEST = 64
ALL_BITS = np.uint64(2**64 - 1)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

_HASHES: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; a worker remembers a bounded number of them."""
    if missing := set(words).difference(_HASHES):
        if len(_HASHES) > REMEMBERED:
            _HASHES.clear()
            missing = set(words)
        for w in missing:
            _HASHES[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[1]
    h = (h ^ (h >> np.uint64(29))) * ODD[0]
    return h ^ (h >> np.uint64(32))


def ranged(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of equal ranges of hashes."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_range(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its entries, in order; only buckets that have some."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[len(order) > 0, np.diff(bucket[order]) > 0, len(order) > 0])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(bucket[order[a]]), order[a:b]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, A-Z lower-cased, one text after the other; and where each text's words begin, and the last one's end.

    Words are read eight bytes at a time from all texts at once: two words of at most eight bytes and of equal length have different hashes.
    """
    joined = b" ".join([b"", *texts, b" " * 8]).lower()
    data = np.frombuffer(joined, np.uint8)
    space = (data == 32) | (data - np.uint8(9) < 5)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, length = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(data) - 7, "<u8", joined, strides=(1,))
    out = length.astype(np.uint64) * ODD[2]
    some = np.arange(len(begin))
    for k in range(0, LONGEST, 8):
        rest = np.minimum(length[some] - k, 8).astype(np.uint64)
        out[some] = mixed(out[some] ^ eight[begin[some] + k] & ALL_BITS >> (np.uint64(64) - np.uint64(8) * rest))
        some = some[length[some] > k + 8]
        if not len(some):
            break
    for i in some.tolist():
        out[i] = xxhash.xxh3_64_intdigest(joined[begin[i] : begin[i] + length[i]])
    starts = np.cumsum(np.array([1, *(len(t) + 1 for t in texts)]))
    return out, np.searchsorted(begin, starts)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in rising order; for many small arrays much faster than ``np.unique``."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]][: len(values)]]


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's distinct shingles in rising order: A-Z lower-cased, words between ASCII white space. Fewer words than ``width`` make one shingle; none make none."""
    own, places = hashed_words(texts)
    n = max(0, len(own) - width + 1)
    total = own[:n] * ODD[0]
    for k in range(1, width):
        total += own[k : k + n] * ODD[k]
    total = mixed(total)
    out, places = [], places.tolist()
    for text, begin, end in zip(texts, places, places[1:]):
        if end - begin >= width:
            out.append(distinct(total[begin : end - width + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()), seed=1)] if end > begin else [], np.uint64))
    return out


def shingle_set(text: bytes) -> np.ndarray:
    return shingle_sets([text])[0]
