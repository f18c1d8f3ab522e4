"""Designs, interventions, validation, readers, writers, learners and streams."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import design, interventions, learning, validation
from tessera.plans import textual
from tessera.sources import tables
from tessera.streaming import events

ATOM = "document_id string, atom_id string, role string"


def inventory(spark, rng, documents=40):
    roles = ("entity", "scope", "period", "numeric", "provenance")
    rows = [(f"d{d}", f"d{d}:{r}:{i}", r) for d in range(documents) for r in rng.sample(roles, rng.randint(1, 5)) for i in range(rng.randint(1, 9))]
    return spark.createDataFrame(rows, ATOM)


def test_probabilities_sum_to_k(spark):
    sums = design.inclusion_probabilities(inventory(spark, random.Random(1)), 3).groupBy("document_id").agg(F.sum("pi").alias("s")).collect()
    assert sums and all(r.s == pytest.approx(3) for r in sums)


def test_focal_draw_ignores_row_order(spark):
    atoms = inventory(spark, random.Random(2))
    a = {tuple(r) for r in design.select_focal(atoms, 4).select("document_id", "atom_id").collect()}
    b = {tuple(r) for r in design.select_focal(atoms.orderBy(F.rand(3)).repartition(7), 4).select("document_id", "atom_id").collect()}
    assert a == b
    per = design.select_focal(atoms, 4).groupBy("document_id").agg(F.count_distinct("role").alias("n")).collect()
    assert all(r.n == 3 for r in per)


def test_instrumentation_is_capped_and_positive(spark):
    plan = design.instrumentation_plan(inventory(spark, random.Random(3)), 5, cap=10)
    for r in plan.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if("selected").alias("k"), F.min("q").alias("q")).collect():
        assert r.k == min(r.n, 10) and r.q > 0
    assert sum(design.allocation(["a", "b", "c"], [100, 1, 1], 10)) == 10


def test_folds_keep_documents_whole(spark):
    folds = design.grouped_folds(inventory(spark, random.Random(4)), 5)
    assert folds.groupBy("document_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    few = design.grouped_folds(spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string"), 5)
    assert {r.fold for r in few.collect()} == {0, 1, 2}


def test_skeleton_arms_match(spark):
    rows = [("d", f"a{i}", r, v, 0, i) for i, (r, v) in enumerate([("scope", "Europe"), ("period", "FY2023"), ("numeric", "5%")])]
    slots = interventions.candidate_tuples(spark.createDataFrame(rows, ATOM + ", canonical_value string, sentence_index int, char_start int"))
    support = spark.createDataFrame([("scope", "EMEA"), ("scope", "Europe"), ("period", "FY2020"), ("numeric", "7%")], "role string, value string")
    blocked = interventions.blocked_values(slots, support, 1)
    assert all(r.blocked_value != r.canonical_value for r in blocked.collect())
    arms = interventions.matched_arms(blocked).collect()
    assert len(arms) == 3 and all(r.matched for r in arms)
    assert next(r for r in arms if r.focal_role == "period").natural == "- scope: Europe\n- period: [OMITTED]\n- numeric: 5%"


def test_allocation_stays_in_budget(spark):
    rows = [("d", f"a{i}", "numeric", f"{i}%", i, s) for i, s in enumerate([0.9, -0.5, 0.8, 0.1])]
    row = interventions.allocate(spark.createDataFrame(rows, ATOM + ", canonical_value string, char_start int, score double"), 10).first()
    assert row.tokens <= 10 and row.n_chosen == 2 and row.utility == pytest.approx(1.7)


def test_eligibility_cascade(spark):
    rows = [
        ("d", "a", "scope", "x", "x", 0, 1, "accepted"), ("d", "b", "entity", "x", "x", 0, 1, "accepted"), ("d", "c", "scope", " ", "y", 2, 3, "accepted"),
        ("d", "e", "scope", "z", "z", 4, 5, "accepted"), ("d", "f", "scope", "w", "w", 8, 9, "rejected"), ("d", "g", "scope", "v", "v", 8, 9, None), ("d", "h", "scope", "u", "u", 8, 9, "accepted"),
    ]
    df = spark.createDataFrame(rows, ATOM + ", canonical_value string, surface_form string, char_start int, char_end int, verification string").withColumn("text", F.lit("x y z-q w."))
    got = {r.atom_id: r.exclusion_reason for r in validation.exclusion_reasons(df).collect()}
    assert got == {"a": "conflict_group", "b": "conflict_group", "c": "degenerate_value", "e": "entangled_surface", "f": "human_rejected", "g": "unverified", "h": None}
    rates = {r.exclusion_reason: r.rate for r in validation.exclusion_rates(validation.exclusion_reasons(df).limit(0)).collect()}
    assert rates == dict.fromkeys(validation.EXCLUSION_REASONS, 0.0)


def test_eligibility_of_lists(spark):
    """The same reasons from documents with their atoms in a list, whose texts are neither copied to atoms nor shuffled."""
    rows = [(d, i, r, v, s, a, b, k) for d in "de" for i, r, v, s, a, b, k in [
        ("a", "scope", "x", "x", 0, 1, "accepted"), ("b", "entity", "x", "x", 0, 1, "accepted"), ("i", "scope", "x", "x", 0, 1, "rejected"), ("c", "scope", " ", "y", 2, 3, "accepted"), ("e", "scope", "z", "z", 4, 5, "accepted"),
        ("f", "scope", "w", "w", 8, 9, "rejected"), ("g", "scope", "v", "v", 8, 9, None), ("h", "scope", "u", "u", 8, 9, "accepted"), ("j", "scope", "h", "h", 8, 9, "accepted"), ("k", "scope", "h", "h", 8, 9, "accepted"),
    ]]
    df = spark.createDataFrame(rows, ATOM + ", canonical_value string, surface_form string, char_start int, char_end int, verification string").withColumn("text", F.lit("x y z-q w."))
    atom = F.struct(*(c for c in df.columns if c not in ("document_id", "text")))
    lists = df.groupBy("document_id", "text").agg(F.collect_list(atom).alias("atoms"))
    for verified in (True, False):
        found = validation.exclusion_reasons(validation.with_conflicts(lists), verified)
        want = {(r.document_id, r.atom_id): r.exclusion_reason for r in validation.exclusion_reasons(df, verified).collect()}
        assert {(r.document_id, r.atom_id): r.exclusion_reason for r in found.collect()} == want
    plan = textual.eligibility_reasons(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "exchange hashpartitioning(document_id" not in plan.lower()


def test_guards():
    with pytest.raises(AssertionError):
        validation.assert_pretreatment(["x", "mean_delta"])
    with pytest.raises(AssertionError):
        validation.assert_not_test("stage2-test")
    validation.assert_not_test("stage2-dev-test")


def test_ridge_matches_the_normal_equations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [0.5, -0.3, 0.0] + 1.5 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(f"d{i % 25}", i % 5, i % 4, *map(float, x[i]), float(y[i])) for i in range(200)], "document_id string, fold int, inner int, x0 double, x1 double, x2 double, y double")
    model = learning.fit_ridge(df, ["x0", "x1", "x2"], "y", (1.0,))
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert np.allclose(model["coef"], want) and len(model["fingerprint"]) == 64
    out = learning.nested_crossfit(df, ["x0", "x1", "x2"], "y", outer="fold", inner="inner").toPandas()
    assert np.corrcoef(out.prediction, out.y)[0, 1] > 0.95


def test_files_round_trip(spark, tmp_path):
    atoms = spark.createDataFrame([("d", "a", "scope", "Europe", "Europe", 0, 6, 0, 1, "accepted"), ("d", "b", "scope", "x", "x", 9, 10, 0, 1, "unverified")], tables.INVENTORY)
    tables.write_inventory(atoms, str(tmp_path / "inv"))
    assert tables.read_inventory(spark, str(tmp_path / "inv")).count() == 1
    assert tables.read_inventory(spark, str(tmp_path / "inv"), accepted_only=False).count() == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.json").write_text('{"document_id": "d",\n "text": "hello"}')
    assert tables.read_documents(spark, str(tmp_path / "docs")).first().text == "hello"
    manifest = tables.file_manifest(spark, str(tmp_path / "docs"))
    assert manifest.first().bytes == 38 and tables.manifest_differences(manifest, manifest).count() == 0
    (tmp_path / "v.txt").write_text("# c\n a \n\n")
    assert [r.value for r in tables.read_vocabulary(spark, str(tmp_path / "v.txt")).collect()] == ["a"]
    (tmp_path / "r.yaml").write_text("baselines:\n  m1: {role: CONTROL, status: READY}\n")
    assert tables.registry_frame(spark, str(tmp_path / "r.yaml"), "name string, role string, status string").first()[:] == ("m1", "CONTROL", "READY")


def test_ledger_refuses_secrets(spark, tmp_path):
    calls = spark.createDataFrame([("a", "fine"), ("b", "sk-abcdefghijklmnopqrstuv")], "call_id string, note string")
    tables.append_ledger(calls.where("call_id = 'a'"), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 1
    with pytest.raises(Exception, match="secret"):
        tables.append_ledger(calls, str(tmp_path / "l"))


def test_cache_refuses_another_model(spark):
    tasks = spark.createDataFrame([("k1",), ("k2",)], "task_key string")
    cache = spark.createDataFrame([("k1", "m", "yes")], "task_key string, returned_model string, answer string")
    hits, misses = tables.cached(tasks, cache, "m")
    assert hits.count() == 1 and misses.first().task_key == "k2"
    with pytest.raises(Exception, match="cached under"):
        tables.cached(tasks, cache, "other")[0].collect()


def test_digest_ignores_partitioning(spark):
    df = spark.range(500).selectExpr("id", "id * 2 AS v")
    a, b = (tables.outcome_digest(d, ["id"]).first() for d in (df, df.repartition(7)))
    assert a == b and a.n_rows == 500


def test_latex_bolds_the_first_best(spark):
    rows = tables.latex_rows(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "name string, v double"), "name", {"v": "max"}).collect()
    got = {r.name: r.row for r in rows}
    assert "textbf" in got["b"] and "textbf" not in got["c"] and "---" in got["d"]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [("r", s, "relay") for s in (1, 2, 4)] + [("q", s, "relay") for s in (1, 2)]
    spark.createDataFrame(rows, "run_id string, sequence long, stage string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, sequence long, stage string").json(str(tmp_path / "in"))
    checked = events.checked_stream(stream).writeStream.format("memory").queryName("checked").outputMode("append").trigger(availableNow=True).start()
    checked.awaitTermination(120)
    bad = spark.sql("SELECT run_id, sequence FROM checked WHERE NOT ok").collect()
    assert [tuple(r) for r in bad] == [("r", 4)]
    batch = spark.read.json(str(tmp_path / "in"))
    assert [(r.run_id, r.sequence) for r in events.monotonic_violations(batch).collect()] == [("r", 4)]
    events.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    with pytest.raises(ValueError):
        events.replay(batch, -1)
