"""Vector codes: every tree's answer against plain comparison, whole runs against a plain Lloyd, odd input."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import vector_codes as V
from tests.llm.test_edges import CLASHING


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 7, 40, 300, 1500]), st.sampled_from([1, 2, 8]), st.sampled_from([1, 3, 16]), st.sampled_from([2, 30, 5000]))
def test_tree_equals_plain_comparison(seed, m, width, k, spread):
    """Small spreads make many ties, which fall to the lower index."""
    rng = np.random.default_rng(seed)
    points = rng.integers(-spread, spread + 1, (m, width))
    book = rng.integers(-spread, spread + 1, (k, width))
    tree = V.Tree.unpacked(V.Tree.build(points).packed())
    far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    near = far.argmin(axis=1)
    codes, errors = tree.assigned(book)
    assert (codes == near).all() and (errors == far.min(axis=1)).all()
    n, sums = tree.totals(book)
    assert n.tolist() == np.bincount(near, minlength=k).tolist()
    assert all((sums[e] == points[near == e].sum(axis=0)).all() for e in range(k))


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(2)
    book = np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]])
    points = book[rng.integers(0, 4, 4000)] + rng.integers(-100, 101, (4000, 2))
    won, leaves, _ = V.Tree.build(points).filtered(book)
    assert sum(len(nodes) for _, nodes, _ in won) > 0
    assert len(leaves) < 20  # of 256: the others' points were never looked at one by one


def plain(rows, parts, entries, rounds):
    """(code, error, digest) of each row of one length, with Python's integers."""
    d = len(rows[0][2])
    most = V.limit(d)
    points = [[max(-most, min(most, int(np.floor(np.float64(x) * 4096)))) for x in v] for _, _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))
    book = [list(points[i]) for i in order[:entries]]
    cuts = [p * d // parts for p in range(parts + 1)]

    def assign():
        out = []
        for x in points:
            row = []
            for a, b in zip(cuts, cuts[1:]):
                far = [sum((s - t) ** 2 for s, t in zip(x[a:b], e[a:b])) for e in book]
                row.append((far.index(min(far)), min(far)))
            out.append(row)
        return out

    for _ in range(rounds):
        got = assign()
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for e in range(len(book)):
                mine = [x[a:b] for x, row in zip(points, got) if row[p][0] == e]
                if mine:
                    book[e][a:b] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = V.digest_of(np.array(book), parts)
    return [("".join(f"{e:02x}" for e, _ in row), sum(f for _, f in row), digest) for row in assign()]


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(5)
    many = [(i, i % 3 if i % 7 else None, rng.normal(0, 0.1, 12).round(3).tolist()) for i in range(90)]
    many += [(3, 1, many[3][2]), (3, 1, many[3][2]), (None, 2, many[4][2]), (91, None, [0.0] * 12), (92, 1, [1e30, -1e30, *[0.5] * 10]), (93, 0, [-0.0001] * 12)]
    short = [(200 + i, 9, rng.normal(0, 1, 5).round(2).tolist()) for i in range(4)]
    bad = [(300, 1, None), (301, 1, [float("nan")] * 12), (302, 1, [float("inf"), *[0.0] * 11]), (303, None, [None, *[0.0] * 11])]
    frame = spark.createDataFrame([*many, *short, *bad], "vec_id long, label int, embedding array<double>")
    return many, short, frame.withColumns({c: F.lit(1) for c in [*CLASHING, "code", "error", "ids", "trees", "_label", "_sum"] if c != "label"})


def test_runs_equal_a_plain_one(odd):
    many, short, frame = odd
    got = sorted((tuple(r) for r in V.vector_codes(frame, parts=4, entries=6, rounds=3).select("vec_id", "label", "code", "error", "codebooks_sha256", "label_error").collect()), key=repr)
    rows = many + short
    codes = plain(many, 4, 6, 3) + plain(short, 4, 6, 3)
    by_label: dict = {}
    for (_, label, _), (_, error, _) in zip(rows, codes):
        by_label[label] = by_label.get(label, 0) + error
    want = sorted(((i, label, *c, min(by_label[label], V.LARGEST)) for (i, label, _), c in zip(rows, codes)), key=repr)
    assert got == want


def test_blocks_and_partitions_do_not_matter(odd, monkeypatch):
    _, _, frame = odd
    kept = frame.select("vec_id", "label", "embedding")
    one = sorted(map(repr, V.vector_codes(kept.coalesce(1), parts=4, entries=6, rounds=2).collect()))
    assert one == sorted(map(repr, V.vector_codes(kept.repartition(13, "vec_id"), parts=4, entries=6, rounds=2).collect()))


def test_empty_table(odd):
    _, _, frame = odd
    assert V.vector_codes(frame.limit(0)).collect() == []
    assert V.vector_codes(frame.where("embedding is null")).collect() == []
    with pytest.raises(ValueError):
        V.vector_codes(frame, entries=257)
