"""The conditional random field's gradient against all label sequences."""

from __future__ import annotations

from itertools import product

import numpy as np

from tracemill.llm import quality_rules as Q


def likelihood(segments, labels, theta):
    """Logarithm of the labels' probability, all sequences written out."""
    emit, move = theta[: 2 * Q.FEATURES].reshape(Q.FEATURES, 2), theta[2 * Q.FEATURES :].reshape(2, 2)
    total = 0.0
    for x, y in zip(segments, labels):
        score = lambda ls: sum((x[t] @ emit)[k] for t, k in enumerate(ls)) + sum(move[a, b] for a, b in zip(ls, ls[1:]))
        total += score(y.astype(int).tolist()) - np.logaddexp.reduce([score(ls) for ls in product((0, 1), repeat=len(x))])
    return total


def test_gradient_against_all_sequences():
    rng = np.random.default_rng(5)
    segments = [rng.normal(size=(n, Q.FEATURES)) for n in (2, 2, 4, 4, 6, 8)]
    labels = [np.arange(len(s)) % 2 == k % 2 for k, s in enumerate(segments)]
    assert sum(y.sum() for y in labels) * 2 == sum(map(len, labels))  # so all weights are 1
    theta = 0.3 * rng.normal(size=2 * Q.FEATURES + 4)
    groups, lines = Q.by_length(segments, labels)
    assert lines == 26 and sum(g[1].sum() for g in groups) == 26 and len(groups) > 2
    found = sum(Q.gradient(g, theta[: 2 * Q.FEATURES].reshape(Q.FEATURES, 2), theta[2 * Q.FEATURES :].reshape(2, 2)) for g in groups)
    for i in rng.choice(len(theta), 12, replace=False).tolist() + [len(theta) - 1, len(theta) - 2]:
        step = np.zeros_like(theta)
        step[i] = 1e-5
        by_hand = (likelihood(segments, labels, theta + step) - likelihood(segments, labels, theta - step)) / 2e-5
        assert abs(found[i] - by_hand) < 1e-5


def test_grouping_changes_nothing():
    rng = np.random.default_rng(6)
    segments = [rng.normal(size=(n, Q.FEATURES)) for n in rng.integers(1, 20, 30)]
    labels = [rng.random(len(s)) < 0.3 for s in segments]
    whole = Q.fit_field(segments, labels)
    # each segment by itself
    emit, move = 0.1 * rng.normal(size=(Q.FEATURES, 2)), rng.normal(size=(2, 2))
    groups, _ = Q.by_length(segments, labels)
    together = sum(Q.gradient(g, emit, move) for g in groups)
    alone = np.zeros_like(together)
    for g in groups:
        for i in range(len(g[1])):
            size = int(g[1][i].sum())
            alone += Q.gradient((g[0][i : i + 1, :size], g[1][i : i + 1, :size], g[2][i : i + 1, :size], g[3][i : i + 1, :size], g[4][i : i + 1, : size - 1]), emit, move)
    assert np.allclose(together, alone) and np.isfinite(whole.emit).all()
