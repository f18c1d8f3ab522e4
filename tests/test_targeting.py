"""Best and random fills of many documents at once, against one document and one draw at a time."""

from __future__ import annotations

import numpy as np

from tessera.operators import calibration as C


def test_documents_side_by_side_are_solved_as_one_by_one():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 7):
        costs, utility = rng.integers(0, 40, (20, n)), rng.integers(-8, 9, (20, n)) / 4
        orders = np.random.default_rng(5)
        drawn = [orders.permutation(n) for _ in range(64)]
        fills = [np.mean([u[C.greedy_fill(c.tolist(), 60, o)].sum() for o in drawn]) for c, u in zip(costs, utility)]
        assert C.mean_fills(costs, utility, 60, 5, 64).tolist() == fills
        for c, u in zip(costs, utility):
            at = sorted(range(n), key=lambda i: (c[i], f"{i:02}"))
            best, ties = C.best_values(c[at][None], u[at][None], 60)
            _, _, value, met = C.knapsack([(f"{i:02}", int(c[i]), float(u[i])) for i in range(n)], 60)
            assert (best[0], ties[0]) == (value, met)


def test_orders_are_drawn_once_for_each_size(monkeypatch):
    made = []
    real = np.random.default_rng
    C._orders.cache_clear()
    monkeypatch.setattr(C.np.random, "default_rng", lambda seed: made.append(seed) or real(seed))
    for _ in range(5):
        C.mean_fills(np.array([[3, 4, 5]]), np.array([[0.5, 1.0, 0.25]]), 8, 1, 16)
    assert made == [1]
