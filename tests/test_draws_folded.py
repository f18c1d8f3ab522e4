"""Draws by folding, against the remainder of whole numbers."""

from __future__ import annotations

import tracemalloc

import numpy as np

from tessera.operators import inference as I


def test_folding_is_the_remainder():
    rng = np.random.default_rng(1)
    high, low = (np.concatenate([rng.integers(0, 1 << 30, 300), [0, 0, (1 << 30) - 1, 1]]) for _ in range(2))
    numbers = [I.WHOLE, *range(40)]
    got = I.times_taken(high, low, numbers, 4)
    for j, r in enumerate(numbers):
        a, b = I.replicate_hashes(4, r)
        drawn = [((int(h) * a + int(x) * b) % I.PRIME) >> (31 - I.DRAW_BITS) for h, x in zip(high, low)]
        assert got[:, j].tolist() == [1.0 if r == I.WHOLE else float(sum(d >= t for t in I.TAKEN)) for d in drawn]


def test_the_prime_itself_folds_to_zero(monkeypatch):
    monkeypatch.setattr(I, "replicate_hashes", lambda seed, r: (I.PRIME, 0))
    assert I.times_taken(np.array([1, 2, 5]), np.array([0, 0, 0]), [0], 0).ravel().tolist() == [0.0, 0.0, 0.0]


def test_few_rows_are_worked_out_at_once():
    high = np.arange(20_000)
    tracemalloc.start()
    times = I.times_taken(high, high, list(range(64)), 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < times.nbytes * 1.5
