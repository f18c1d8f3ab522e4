"""Joins by order and overlap against comparing all pairs, for stretches of any width."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals as I

WIDTHS = [1, 7, 1000]


@pytest.fixture(scope="module")
def sides(spark):
    """One group holds most rows; positions repeat, and keys and positions are null now and then."""
    rng = random.Random(3)
    group = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, group(), rng.choice([None, *range(-20, 60)])) for i in range(300)]
    right = [(i, group(), rng.choice([None, *range(-30, 50, 3)])) for i in range(120)]
    return left, right, spark.createDataFrame(left, "i int, g string, at int").withColumn("_side", F.lit("x")), spark.createDataFrame(right, "j int, g string, at int").withColumn("more", F.col("j") * 2)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("tolerance", [None, 4])
@pytest.mark.parametrize("forward", [False, True])
def test_as_of_equals_all_pairs(sides, width, tolerance, forward):
    left, right, a, b = sides
    got = sorted((r.i, r.j, r.more, r._side) for r in I.as_of(a, b, ["g"], "at", ["j", "more"], width, tolerance, forward).collect())
    want = []
    for i, g, at in left:
        near = [(abs(at - p), -j) for j, h, p in right if None not in (g, at, h, p) and h == g and (p >= at if forward else p <= at)] if at is not None else []
        best = min(near, default=(None, None))
        j = None if best[0] is None or (tolerance is not None and best[0] > tolerance) else -best[1]
        want.append((i, j, None if j is None else 2 * j, "x"))
    assert got == sorted(want, key=lambda r: r[0])


@pytest.mark.parametrize("width", WIDTHS)
def test_points_in_disjoint_intervals(spark, width):
    intervals = [("t", 0, 5, "first"), ("t", 5, 6, "second"), ("t", 10, 40, "third"), ("u", 3, 3, "empty"), ("u", 7, 9, "only")]
    points = [(i, g, p) for i, (g, p) in enumerate((g, p) for g in "tuv" for p in range(-1, 42))]
    got = {r.i: r.name for r in I.covering(spark.createDataFrame(points, "i int, g string, at int"), spark.createDataFrame(intervals, "g string, s int, e int, name string"), ["g"], "at", "s", "e", ["name"], width).collect()}
    want = {i: next((n for h, s, e, n in intervals if h == g and s <= p < e), None) for i, g, p in points}
    assert got == want


@pytest.mark.parametrize("width", WIDTHS)
def test_overlaps_equal_all_pairs(spark, width):
    rng = random.Random(7)
    spans = lambda n: [(i, rng.choice(["hot", "hot", "b", None]), s := rng.randint(-9, 40), s + rng.choice([0, 1, 5, 17, -2])) for i in range(n)]
    a, b = spans(80), spans(60) + [(99, "hot", None, 5)]
    left, right = spark.createDataFrame(a, "i int, g string, s int, e int"), spark.createDataFrame(b, "j int, g string, c int, d int")
    got = sorted((r.i, r.j) for r in I.overlapping(left, right, ["g"], ("s", "e"), ("c", "d"), width).collect())
    want = sorted((i, j) for i, g, s, e in a for j, h, c, d in b if c is not None and g == h and g is not None and s < e and c < d and s < d and c < e)
    assert got == want


def test_greedy_fold_equals_taking_one_by_one(spark):
    rng = random.Random(9)
    rows = [(g, s := rng.randint(0, 60), s + rng.randint(1, 12), rng.randint(0, 3), i) for i, g in enumerate(rng.choice("abc") for _ in range(150))]
    got = sorted(tuple(r) for r in I.greedy_disjoint(spark.createDataFrame(rows, "g string, s int, e int, rank int, i int"), ["g"], "s", "e", ["rank"]).collect())
    kept: list = []
    for r in sorted(rows, key=lambda r: (r[3], r[1], r[2], r[4])):
        if not any(k[0] == r[0] and k[1] < r[2] and r[1] < k[2] for k in kept):
            kept.append(r)
    assert got == sorted(kept)


def test_empty_sides(sides):
    _, _, a, b = sides
    assert I.as_of(a.limit(0), b, ["g"], "at", ["j"], 5).count() == 0
    assert I.as_of(a, b.limit(0), ["g"], "at", ["j"], 5).where("j IS NOT NULL").count() == 0
    assert I.greedy_disjoint(a.limit(0).withColumn("e", F.col("at")), ["g"], "at", "e", ["i"]).count() == 0
