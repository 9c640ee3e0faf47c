"""A suffix array by two-stage sorting, and its adjacent common prefixes, in numpy.

Only suffixes smaller than their successors are sorted directly. The others follow from scanning the buckets of first
bytes from the least up: whenever a suffix is met, its predecessor, if larger than it, is the next of its own bucket.
"""

from __future__ import annotations

import numpy as np

WORDS = 7  # directly compared: 56 bytes


def word_at(text: np.ndarray, places: np.ndarray, offset: int) -> np.ndarray:
    """Eight bytes from each place on as a number that compares as they do; zeros follow the text."""
    view = np.ndarray((len(text) - 8 * WORDS - 8 + 1,), np.dtype(">u8"), buffer=text, offset=offset, strides=(1,))
    return view[places].astype(np.uint64)


def padded(text: bytes) -> np.ndarray:
    return np.frombuffer(text + bytes(8 * WORDS + 8), np.uint8)


def sort_directly(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places in the order of their first 56 bytes: by a word at a time, and further only where words tie."""
    key = word_at(text, places, 0)
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    for level in range(1, WORDS):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same]) if len(group) else group
        if not len(tied):
            break
        key = word_at(text, places[tied], 8 * level)
        order = np.lexsort((key, group[tied]))
        places[tied] = places[tied][order]
        key = key[order]
        new = np.zeros(len(group), np.int64)
        new[tied[1:]] = (group[tied][1:] == group[tied][:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(new)
    return places


def suffix_array(text: bytes) -> np.ndarray:
    """Starts of all suffixes in rising order; ties over 56 bytes or more may stand in any order."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    data = padded(text)
    t = data[:n].astype(np.int64)
    differ = np.r_[t[1:] != t[:-1], True]
    at = np.minimum.accumulate(np.where(differ, np.arange(n), n)[::-1])[::-1]
    smaller = np.r_[t, -1][at + 1] > t  # the last suffix is larger than the empty one
    direct = sort_directly(data, np.flatnonzero(smaller))
    bounds = np.searchsorted(t[direct], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues[t[-1]].append(np.array([n - 1]))
    out = []

    def induce(met: np.ndarray, first: int) -> np.ndarray:
        """Hands on the larger predecessors of what was met; those of the same bucket are returned."""
        before = met[met > 0] - 1
        before = before[~smaller[before]]
        bytes_of = t[before]
        for c in np.unique(bytes_of[bytes_of > first]).tolist():
            queues[c].append(before[bytes_of == c])
        return before[bytes_of == first]

    for c in range(256):
        wave = np.concatenate(queues[c]) if queues[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        own = direct[bounds[c] : bounds[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    return np.concatenate(out)


def common_prefixes(text: bytes, suffixes: np.ndarray, most: int) -> np.ndarray:
    """How many bytes each suffix shares with the one before it, counted up to ``most`` (56 at most); the first shares none."""
    data = padded(text)
    shared = np.zeros(len(suffixes), np.int64)
    going = np.arange(1, len(suffixes))
    for level in range(-(-most // 8)):
        if not len(going):
            break
        x = word_at(data, suffixes[going], 8 * level) ^ word_at(data, suffixes[going - 1], 8 * level)
        equal = x == 0
        split = np.zeros(len(x), np.int64)
        for k in range(1, 8):
            split += x < np.uint64(1) << np.uint64(8 * k)
        shared[going] += np.where(equal, 8, split)
        going = going[equal]
    return np.minimum(shared, most)
