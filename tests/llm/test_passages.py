"""Edited passages whose lines all occur in different earlier documents."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tracemill.llm import passage_chains


def scattered(seed, line, share, n=30):
    """Documents with single lines, then documents with passages made of these, then edited copies; and where those are."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["ba", "co", "du", "el", "fi", "ne", "po", "ra"]) for _ in range(rng.randrange(1, 4))) for _ in range(900)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    single, whole, copies = [], [], []
    for _ in range(n):
        lines = [words(line) for _ in range(max(4, round(90 / line)))]
        single += [words(rng.randrange(10, 40)) + x + words(rng.randrange(10, 40)) for x in lines]
        passage = sum(lines, [])
        whole.append(words(30) + passage + words(30))
        own = []
        for w in passage:
            kind = rng.randrange(3) if rng.random() < share else 3
            own += [rng.choice(vocabulary)] if kind == 0 else [] if kind == 1 else [w, rng.choice(vocabulary)] if kind == 2 else [w]
        before = words(rng.randrange(20, 60))
        copies.append((before + own + words(30), len(before), len(before) + len(own)))
    rng.shuffle(single)
    rows = [(i, " ".join(x)) for i, x in enumerate(single)] + [(10_000 + i, " ".join(x)) for i, x in enumerate(whole)] + [(20_000 + i, " ".join(x)) for i, (x, _, _) in enumerate(copies)]
    return rows, {20_000 + i: (a, b) for i, (_, a, b) in enumerate(copies)}


def test_scattered_passages_are_found(spark):
    """At least nine of ten, each with at least nine tenths of its words, for lines of 9 to 20 words and 5 to 12 % of words edited; and little else in those documents."""
    cases = [(9, 0.05), (9, 0.12), (12, 0.05), (12, 0.12), (20, 0.05), (20, 0.12)]
    rows, places = [], {}
    for k, (line, share) in enumerate(cases):
        own, there = scattered(k, line, share)
        rows += [(i + 100_000 * k, f"{t}") for i, t in own]
        places |= {i + 100_000 * k: p for i, p in there.items()}
    found: dict[int, set[int]] = {}
    for r in passage_chains.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    for k, case in enumerate(cases):
        own = {i: p for i, p in places.items() if i // 100_000 == k}
        right = sum(len(found.get(i, set()) & {*range(*p)}) >= 0.9 * (p[1] - p[0]) for i, p in own.items())
        assert right >= 0.9 * len(own), (case, right)
        assert sum(len(found.get(i, set()) - {*range(*p)}) for i, p in own.items()) <= 3 * len(own)


def best_by_hand(a, b):
    """The best score of beginnings, by the full table."""
    score = {(0, 0): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                both = [score[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1)] if i and j else []
                score[i, j] = max(both + ([score[i - 1, j] - 1] if i else []) + ([score[i, j - 1] - 1] if j else []))
    return max(score.values())


@pytest.mark.parametrize("seed", range(20))
def test_extension_finds_the_best_beginnings(seed):
    rng = random.Random(seed)
    a = [rng.randrange(50) for _ in range(40)]
    b = [x for x in a[:25] if rng.random() > 0.08] + [rng.randrange(50, 90) for _ in range(12)]
    far, far_b, equal = passage_chains.extended(np.array(a, np.uint32), np.array(b, np.uint32))
    # the beginnings it takes are as good as the best, by the same table
    assert best_by_hand(a, b) == best_by_hand(a[:far], b[:far_b]) and equal <= min(far, far_b)


def test_extension_of_nothing():
    none, some = np.zeros(0, np.uint32), np.arange(5, dtype=np.uint32)
    assert passage_chains.extended(none, some) == (0, 0, 0) == passage_chains.extended(some, none)
    assert passage_chains.extended(some, some) == (5, 5, 5)
    assert passage_chains.extended(some, some + 100) == (0, 0, 0)


def test_pairs_take_the_least_within_reach():
    h = np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64)
    at, token = passage_chains.pairs_of(h)
    width, reach = passage_chains.WIDTH, passage_chains.REACH
    assert at.tolist() == [i for i in range(len(h) - width - reach) if h[i] % np.uint64(3) == 0]
    for i, t in zip(at.tolist(), token):
        j = min(range(i + width, i + width + reach + 1), key=lambda j: (int(h[j]) >> 16, j % 2**16))
        assert t == passage_chains.mixed(h[i : i + 1] * passage_chains.ODD[2] + h[j : j + 1] * passage_chains.ODD[3])[0]
    assert len(passage_chains.pairs_of(h[:20])[0]) == 0
