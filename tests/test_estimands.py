"""Known answers, existence rules and identities of the estimators."""

from __future__ import annotations

import math
import random

import pytest

from tessera.operators import calibration, estimands, inference

RECORD = "document_id string, atom_id string, role string, pi double, q double, transmitted int, r_minus double, d_plus double"


def frame(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def known(spark):
    values = [(0.25, 1, 1.0, 1.0), (0.50, 1, 0.0, 1.0), (0.20, 0, 1.0, 1.0), (0.80, 0, 0.0, 0.0)]
    return frame(spark, [("d", f"a{i}", "numeric", pi, 1.0, t, r, d) for i, (pi, t, r, d) in enumerate(values)])


def test_selection_bias_by_hand(spark):
    row = estimands.decompose(known(spark)).first()
    assert row.t_bar == pytest.approx(6 / 12.25)
    assert row.r_observational == pytest.approx(5 / 6.25)
    for name in ("selection_bias", "selection_bias_identity", "selection_bias_conditional"):
        assert row[name] == pytest.approx(0.0653061, abs=1e-6)
    assert row.selection_bias_max_discrepancy < 1e-12 and abs(row.identity_residual) < 1e-12


def test_undefined_is_null(spark):
    sent = frame(spark, [("d", "a", "scope", 0.5, 1.0, 1, 0.0, 0.0)])
    row = estimands.decompose(sent).first()
    assert row.r_observational is None and row.selection_bias is None and row.phi is None
    kept = frame(spark, [("d", "a", "scope", 0.5, 1.0, 0, 1.0, 1.0)])
    row = estimands.decompose(kept, atom_level=False).first()
    assert row.r_observational == 1.0 and row.selection_bias is None and row.prob_delta_negative is None
    assert estimands.decompose(kept.limit(0)).count() == 0


def test_identity_on_random_records(spark):
    rng = random.Random(5)
    rows = [(f"g{g}", f"a{i}", "scope", rng.uniform(0.05, 1), 1.0, rng.randint(0, 1), float(rng.randint(0, 1)), float(rng.randint(0, 1))) for g in range(60) for i in range(rng.randint(6, 40))]
    for r in estimands.decompose(frame(spark, rows), ["document_id"]).collect():
        assert abs(r.identity_residual) < 1e-10
        assert r.selection_bias_max_discrepancy is None or r.selection_bias_max_discrepancy < 1e-9


@pytest.mark.parametrize("pi", [0.0, -0.1, 1.5, math.nan])
def test_improper_probability_is_an_error(spark, pi):
    with pytest.raises(Exception, match="pi must lie"):
        estimands.decompose(frame(spark, [("d", "a", "scope", pi, 1.0, 1, 0.0, 1.0)])).collect()


def test_pooled_row_counts_documents_once(spark):
    rows = [("d", "a", "scope", 0.5, 1.0, 1, 0.0, 1.0), ("d", "b", "period", 0.5, 1.0, 0, 1.0, 1.0)]
    got = {r.role: r.n_documents for r in estimands.decompose_by_role(frame(spark, rows)).collect()}
    assert got == {"scope": 1, "period": 1, "pooled": 1}


def test_region_and_gate(spark):
    rows = {r.mechanism: r for r in estimands.population_region(known(spark), 0.1, 0.0, 0.2).collect()}
    assert rows["del"].point_corrected == pytest.approx(rows["del"].point_raw + 0.1) and rows["pooled"].n == 4
    with pytest.raises(ValueError):
        estimands.population_region(known(spark), 0, 0, -1)


def test_constant_offset_and_common_documents(spark):
    rows = [(f"d{i:02d}", c, 0.1, 0.08) for i in range(20) for c in ("p", "q", "r")] + [("lone", "p", 9.0, 9.0)]
    out = inference.simultaneous_bootstrap(spark.createDataFrame(rows, "document_id string, comparator string, delta_a double, delta_c double"), 100).collect()
    assert all(r.n_documents == 20 and r.lower_a == pytest.approx(0.1) and r.verdict == "INELIGIBLE" for r in out)


def test_draws_are_as_many_as_documents_and_intervals_as_of_resampling(spark):
    import random

    rng = random.Random(5)
    data = [(str(i), rng.gauss(1.0, 2.0), rng.choice([1.0, 2.0])) for i in range(80)]
    stats = spark.createDataFrame(data, "document_id string, a double, b double")
    sums = inference.replicate_sums(stats, ["a", "b"], 2000, 3).collect()
    assert sorted(r.replicate for r in sums) == list(range(2000))
    assert sum(r.times for r in sums) / 2000 == pytest.approx(80, rel=0.01)
    row = inference.bootstrap_ratio(stats, "a", "b", 2000, 3).first()
    values = []
    for _ in range(20_000):
        drawn = rng.choices(data, k=80)
        values.append(sum(d[1] for d in drawn) / sum(d[2] for d in drawn))
    values.sort()
    width = values[19_499] - values[499]
    assert row.lower == pytest.approx(values[499], abs=0.08 * width) and row.upper == pytest.approx(values[19_499], abs=0.08 * width)


def test_paired_bootstrap_needs_the_same_documents(spark):
    a = spark.createDataFrame([("x", 1.0, 2.0), ("y", 1.0, 1.0)], "document_id string, a double, b double")
    with pytest.raises(ValueError):
        inference.paired_bootstrap(a, a.where("document_id = 'x'"), "a", "b", 10)
    row = inference.paired_bootstrap(a, a, "a", "b", 10).first()
    assert row.point == 0 and row.lower == 0 and row.upper == 0


def test_bootstrap_brackets_the_point_and_repeats(spark):
    stats = spark.createDataFrame([(f"d{i}", float(i % 7), 5.0) for i in range(30)], "document_id string, a double, b double")
    one, two = (inference.bootstrap_ratio(stats, "a", "b", 200, 3).first() for _ in range(2))
    assert one == two and one.lower <= one.point <= one.upper and one.n_replicates == 200


def test_superiority_needs_every_win_at_three_families(spark):
    named = spark.createDataFrame([(c,) for c in "abc"], "comparator string")
    none = named.limit(0).selectExpr("comparator", "comparator AS family")
    wins = lambda last: spark.createDataFrame([("a", 0.1, 0.1), ("b", 0.1, 0.1), ("c", last, 0.1)], "comparator string, lower_a double, lower_c double")
    assert inference.superiority(wins(0.1), named, none, named).first().permitted
    assert not inference.superiority(wins(-0.1), named, none, named).first().permitted
    with pytest.raises(ValueError):
        inference.superiority(wins(0.1), named, none, named.where("comparator <> 'c'"))


def test_kappa_and_wilson_edges(spark):
    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert inference.cohen_kappa(same, "a", "b").first().kappa == 1.0
    from pyspark.sql import functions as F

    low, high = inference.wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(low, high).first()[:] == (0.0, 1.0)


def test_replication_rule(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*(v.alias(k) for k, v in calibration.replication_columns(F.lit(0.0141), F.lit(0.138416)).items())).first()
    assert row.m_star == 2 and row.criterion_met and not row.hierarchical_bootstrap_required
    row = spark.range(1).select(*(v.alias(k) for k, v in calibration.replication_columns(F.lit(0.1), F.lit(0.0)).items())).first()
    assert row.m_star == 5 and row.ratio == math.inf


def test_budgets(spark):
    costs = spark.createDataFrame([("a", c) for c in (160, 169, 170)] + [("b", c) for c in (180, 187, 190)], "receiver string, cost int")
    row = calibration.receiver_budgets(costs).first()
    assert (row.f_star, row.b1, row.b2, row.b3) == (178.0, 89, 119, 200)
    tie = spark.createDataFrame([(400,)], "cost int")
    assert calibration.primary_budget(tie, grid=(160, 200, 266)).first().budget == 200


def test_dose_response_keeps_empty_bins(spark):
    probes = spark.createDataFrame([("low", 0.2), ("high", 0.1)], "bin string, r double")
    rows = {r.bin: r for r in calibration.dose_response(probes, "r").collect()}
    assert rows["medium"].n == 0 and rows["medium"].mean is None and not rows["low"].monotone_increasing


def test_knapsack_matches_brute_force():
    from itertools import combinations

    rng = random.Random(3)
    for _ in range(60):
        items = [(f"i{k}", rng.randint(1, 9), round(rng.uniform(-1, 1), 3)) for k in range(rng.randint(3, 9))]
        budget = rng.randint(5, 30)
        best = max(sum(x[2] for x in c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(x[1] for x in c) <= budget)
        chosen, cost, value, _ = calibration.knapsack(items, budget)
        assert value == pytest.approx(best) and cost <= budget and all(u > 0 for i, _, u in items if i in chosen)
        assert chosen == calibration.knapsack(items[::-1], budget)[0]
