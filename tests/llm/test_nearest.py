"""Nearest neighbours: recall and exact scores against brute force, hubs, copies, odd input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import nearest as N, queries as Q
from tests.llm.test_edges import CLASHING


def brute(rows, asked, k):
    """{query: [(vec_id, distance)]} over distinct (id, vector) rows of one length."""
    rows = [(i, np.array(v, dtype=np.float64)) for i, v in {(i, tuple(v)) for i, v in rows}]
    out = {}
    for q, x in rows:
        if q is None or not asked(q):
            continue
        far = {}
        for i, y in rows:
            if i != q and len(y) == len(x):
                d = float(np.sqrt(((x - y) ** 2).sum()))
                far[i] = min(d, far.get(i, d))
        out.setdefault(q, {})
        for i, d in far.items():
            out[q][i] = min(d, out[q].get(i, d))
    order = lambda x: (x[1], x[0] is None, x[0] or 0)
    return {q: sorted(far.items(), key=order)[:k] for q, far in out.items() if far}


def found(df):
    got: dict = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert all([x[0] for x in sorted(rows)] == list(range(1, len(rows) + 1)) for rows in got.values())
    return {q: [(v, d) for _, v, d in sorted(rows)] for q, rows in got.items()}


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    got = found(Q.QUERIES["op11_nearest_vectors"](spark, folder))
    assert set(got) == set(want)
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))
    exact = dict(rows)
    for q, near in got.items():
        for v, d in near:
            assert d == pytest.approx(float(np.linalg.norm(np.array(exact[q], dtype=float) - np.array(exact[v], dtype=float))), abs=1e-12)


def test_hubs_clusters_and_copies(spark):
    """A third of the rows are copies of one vector, a third lie on a small ball around it, and small clusters stand far off."""
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 1, 8).round(3)
    rows = [(i, centre.tolist()) for i in range(0, 900)]
    rows += [(i, (centre + rng.normal(0, 1e-4, 8)).tolist()) for i in range(900, 1800)]
    far = rng.normal(0, 50, (30, 8))
    rows += [(i, (far[i % 30] + rng.normal(0, 0.1, 8)).tolist()) for i in range(1800, 2700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(N.nearest_vectors(df, F.col("vec_id") % 50 == 0, width=128))
    want = brute(rows, lambda i: i % 50 == 0, 10)
    assert set(got) == set(want)
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[50] == [(i, 0.0) for i in range(10)]
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.97 * sum(map(len, want.values()))


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (8, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]), (None, rows[9][1]), (100, [1.0, 2.0]), (101, [2.0, 2.0]), (102, [9.0])]
    bad = [(103, None), (104, [0.0] * 6), (105, [float("nan")] * 6), (106, [float("inf")] + [0.0] * 5), (107, [None] * 6), (108, [])]
    return rows, spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in [*CLASHING, "node", "query", "rank", "d", "open"]})


def test_odd_rows_ties_and_lengths(odd):
    rows, df = odd
    rows = [(i, [x + 0.0 for x in v]) for i, v in rows if any(v)]
    got = found(N.nearest_vectors(df, F.lit(True)))
    want = brute(rows, lambda i: True, 10)
    assert set(got) == set(want)
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]], q
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in want[q]])


def test_few_or_no_rows(odd):
    _, df = odd
    assert N.nearest_vectors(df.limit(0), F.lit(True)).collect() == []
    assert N.nearest_vectors(df.where("vec_id = 102"), F.lit(True)).collect() == []
    assert len(N.nearest_vectors(df.where("vec_id in (1, 2, 3)"), F.lit(True)).collect()) == 6


def test_a_hubs_reverse_links_meet_in_blocks(spark, monkeypatch):
    """Every pair of a hub's followers in a block, and every follower with the hub's own links, is compared."""
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = np.random.default_rng(6)
    points = rng.normal(0, 1, (41, 5))
    nodes = spark.createDataFrame([(i, 5, points[i].tolist()) for i in range(41)], "node long, size int, embedding array<double>")
    hub = [(i, 0, 9.0, True) for i in range(1, 41)] + [(0, 1, 9.0, True)]
    links = N._descended(nodes, spark.createDataFrame(hub, "u long, v long, d double, new boolean"), 8).where("new")
    got = {(r.u, r.v): r.d for r in links.collect()}
    for i in range(2, 41):
        assert (1, i) in got and (i, 1) in got
    assert all(d == pytest.approx(float(((points[u] - points[v]) ** 2).sum())) for (u, v), d in got.items())
