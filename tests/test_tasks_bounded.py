"""Tasks that hold whole documents grow in number with the table, not in size."""

from __future__ import annotations

import pytest

from tessera.operators import estimands, ranks
from tessera.plans import adapters, catalog

DATA = "/root/testdata/sf0.001"


def test_records_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(ranks, "TASK_ROWS", 100)
    rows = adapters.read(spark, DATA, "lineitem").count()
    assert adapters.records(spark, DATA).rdd.getNumPartitions() >= rows / 100


@pytest.mark.parametrize("name", ["decompose_by_role", "decompose_by_hop", "decompose_two_phase", "decomposition_bars", "latex_table", "figure_selection_bias"])
def test_documents_are_shuffled_once(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line and "document_id" in line for line in plan.splitlines()) == 1


def test_documents_count_once_in_the_whole(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), (None, "y"), ("c", None)]
    records = spark.createDataFrame([(*r, 0.5, 1, 1.0, 0.0) for r in rows], "document_id string, role string, pi double, transmitted int, d_plus double, r_minus double")
    found = {r["role"]: (r["n_atoms"], r["n_documents"]) for r in estimands.decompose_by_role(records).collect()}
    assert found == {"x": (2, 1), "y": (3, 2), None: (1, 1), "pooled": (6, 3)}
    assert estimands.decompose(records).select("n_atoms", "n_documents").first() == (6, 3)
    assert estimands.decompose(records.limit(0)).count() == 0 and estimands.decompose(records, ["document_id"]).count() == 4


def test_a_review_is_joined_in_tasks_that_do_not_grow(spark, monkeypatch):
    """Facts are dealt by their number."""
    monkeypatch.setattr(ranks, "TASK_ROWS", 1000)
    reviewed = catalog.queries()["review_applied"](spark, DATA)
    assert reviewed.rdd.getNumPartitions() == 30  # five facts of each of 6,000 lines
