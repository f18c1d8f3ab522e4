"""Bootstraps of any statistic against resampling row by row; quantiles against sorting."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import inference, quantiles as Q, resampling as R

REPLICATES, SEED = 60, 4


def times(document: str, replicate: int) -> int:
    """How often a replicate takes a document, with whole numbers only."""
    bits = lambda *parts: int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    h, g = bits(SEED, document), bits(SEED, "replicate", replicate)
    low = (1 << 30) - 1
    u = ((h >> 30) * (g >> 30) + (h & low) * (g & low)) % (2**31 - 1) >> 16
    return sum(u >= round(2**15 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(7))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    listed = [(f"d{i % 90}", float(x)) for i, x in enumerate(rng.normal(0, 1, 700).round(1))]
    listed += [(f"d{i}", 0.3) for i in range(0, 90, 2)] * 3 + [("d1", 50.0), ("d2", -40.0)]
    df = spark.createDataFrame([*listed, ("d3", None), ("d4", float("nan"))], "document_id string, x double")
    return listed, df.withColumn("v", F.lit(1)).withColumn("bin", F.lit(2))


def resampled(listed, statistic):
    out = {}
    taken = {(d, r): times(d, r) for d in {d for d, _ in listed} for r in range(REPLICATES)}
    for r in range(REPLICATES):
        out[r] = statistic(np.sort([x for d, x in listed for _ in range(taken[d, r])]))
    out[R.WHOLE] = statistic(np.sort([x for _, x in listed]))
    return out


STATISTICS = {
    "median": (lambda: R.quantile(F.col("x"), 0.5), np.median),
    "p97": (lambda: R.quantile(F.col("x"), 0.97), lambda x: np.percentile(x, 97)),
    "least": (lambda: R.quantile(F.col("x"), 0.0), np.min),
    "trimmed": (lambda: R.trimmed_mean(F.col("x"), 0.2), lambda x: x[int(0.2 * len(x)) : len(x) - int(0.2 * len(x))].mean()),
    "untrimmed": (lambda: R.trimmed_mean(F.col("x"), 0.0), np.mean),
    "tail": (lambda: R.upper_tail_mean(F.col("x"), 0.05), lambda x: x[-max(1, math.ceil(len(x) * 0.05)) :].mean()),
}


@pytest.mark.parametrize("resolved", [10**8, 300])
@pytest.mark.parametrize("name", STATISTICS)
def test_every_replicate_equals_row_by_row(rows, name, resolved, monkeypatch):
    """With a small number of pairs to resolve, bins are cut finer again and again."""
    monkeypatch.setattr(R, "RESOLVED", resolved)
    listed, df = rows
    statistic, plain = STATISTICS[name]
    got = {r.replicate: r.v for r in R.replicate_values(df, statistic(), REPLICATES, SEED).collect()}
    want = resampled(listed, plain)
    assert set(got) == set(want)
    assert all(got[r] == pytest.approx(want[r], abs=1e-12) for r in want)


def test_interval_and_point(rows):
    listed, df = rows
    want = resampled(listed, np.median)
    r = R.bootstrap(df, R.quantile(F.col("x"), 0.5), REPLICATES, SEED).first()
    ends = [want[k] for k in range(REPLICATES)]
    assert (r.point, r.n_documents, r.n_replicates) == (want[R.WHOLE], 90, REPLICATES)
    assert [r.lower, r.upper] == pytest.approx([np.percentile(ends, 2.5), np.percentile(ends, 97.5)])


def test_sums_and_correlation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 300)
    y = x + rng.normal(0, 1, 300)
    df = spark.createDataFrame([(f"d{i % 40}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("d1", None, 3.0)], "document_id string, x double, y double")
    got = {r.replicate: r.v for r in R.replicate_values(df, R.correlation(F.col("x"), F.col("y")), 20, SEED).collect()}
    assert got[R.WHOLE] == pytest.approx(np.corrcoef(x, y)[0, 1])
    for r in range(20):
        n = np.array([times(f"d{i % 40}", r) for i in range(300)])
        assert got[r] == pytest.approx(np.corrcoef(np.repeat(x, n), np.repeat(y, n))[0, 1])


def test_a_users_own_states(rows):
    """The spread between the largest and the least value taken, which no sum gives."""
    listed, df = rows

    def add(state, values, taken):
        import numpy as np

        x = np.where(taken.T > 0, values[None, :, 0], np.nan)
        x = np.concatenate([x, np.full((len(x), 1), np.nan)], axis=1)
        state = state.copy()
        state[:, 0] = np.fmin(state[:, 0], np.fmin.reduce(x, axis=1))
        state[:, 1] = np.fmax(state[:, 1], np.fmax.reduce(x, axis=1))
        return state

    def merge(a, b):
        import numpy as np

        return np.stack([np.fmin(a[:, 0], b[:, 0]), np.fmax(a[:, 1], b[:, 1])], axis=1)

    spread = R.States(["x"], lambda n: np.full((n, 2), np.nan), add, merge, lambda s: s[:, 1] - s[:, 0])
    got = {r.replicate: r.v for r in R.replicate_values(df.where("x IS NOT NULL AND NOT isnan(x)"), spread, REPLICATES, SEED).collect()}
    want = resampled(listed, lambda x: x[-1] - x[0])
    assert got == pytest.approx(want)


def test_paired_and_refusals(rows):
    _, df = rows
    moved = df.withColumn("x", F.col("x") + 2)
    r = R.paired_statistic(moved, df, R.quantile(F.col("x"), 0.5), 30, SEED).first()
    assert [r.point, r.lower, r.upper] == pytest.approx([2.0, 2.0, 2.0])
    with pytest.raises(ValueError, match="one arm"):
        R.paired_statistic(df, df.where("document_id <> 'd5'"), R.quantile(F.col("x"), 0.5), 5, SEED)
    with pytest.raises(ValueError, match="no documents"):
        R.bootstrap(df.limit(0), R.quantile(F.col("x"), 0.5), 5, SEED)


def test_documents_alike_in_one_hash_are_drawn_apart():
    """Two documents that agree in the first 30 bits have unlike draws, which a single hash modulo a prime could not give."""
    high, low = np.array([5, 5]), np.array([1, 2])
    taken = inference.times_taken(high, low, list(range(4000)), 3)
    assert taken.mean() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(taken)[0, 1]) < 0.05


@pytest.mark.parametrize("groups", [[], ["g"], ["g", "h"]])
def test_quantiles_equal_sorting(spark, groups):
    rng = np.random.default_rng(2)
    listed = [(["a", "b", None][i % 3], i % 2, None if i % 11 == 0 else float(x)) for i, x in enumerate(rng.normal(0, 3, 2000).round(1))] + [("alone", 0, 7.0), ("nulls", 0, None)] + [("a", 0, 1.5)] * 3000
    df = spark.createDataFrame(listed, "g string, h int, x double").withColumn("_n", F.lit(1))
    probs = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "top": 1.0}
    got = {tuple(r[k] for k in groups): r for r in Q.quantiles(df, "x", probs, groups).collect()}
    want: dict = {}
    for g, h, x in listed:
        if x is not None:
            want.setdefault(tuple({"g": g, "h": h}[k] for k in groups), []).append(x)
    assert set(got) == set(want)
    for k, xs in want.items():
        assert got[k].n == len(xs)
        assert [got[k][name] for name in probs] == pytest.approx([np.percentile(xs, 100 * p) for p in probs.values()])


def test_quantiles_of_nothing(spark):
    r = Q.quantiles(spark.createDataFrame([(None,)], "x double"), "x", {"mid": 0.5}).first()
    assert (r.mid, r.n) == (None, 0)


def test_sums_are_drawn_once_for_a_document(rows, monkeypatch):
    """Many rows of one document are one row before any draw is made, and count as many."""
    listed, df = rows
    many = df.where("x IS NOT NULL AND NOT isnan(x)")
    drawn = []
    sums = R.replicate_sums
    monkeypatch.setattr(R, "replicate_sums", lambda stats, *a, **k: drawn.append(stats.count()) or sums(stats, *a, **k))
    values = {r["replicate"]: r["v"] for r in R.replicate_values(many, R.mean_of(F.col("x")), REPLICATES, SEED).collect()}
    assert drawn == [len({d for d, _ in listed})]
    assert values == pytest.approx(resampled(listed, np.mean))
