"""What looks at all facts of a document works where they were found: nothing is shuffled after that."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import atoms as A
from tessera.functions.draws import draw
from tessera.operators import design, interventions, validation
from tessera.plans import adapters, catalog

DATA = "/root/testdata/sf0.001"
COLUMNS = ("document_id", "atom_id", "role", "canonical_value", "char_start")


@pytest.mark.parametrize("name", ["render_message", "mock_receiver", "masked_contexts", "sham_edits", "counterfactual", "allocation"])
def test_nothing_is_shuffled_after_facts_are_found(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.rsplit("MapInArrow", 1)[0]


def test_lists_and_rows_of_facts_agree(spark):
    frames = adapters.disclosures(spark, DATA).limit(60).localCheckpoint().withColumn("mark", F.upper("document_id"))
    frames = frames.unionByName(spark.createDataFrame([("none", "Nothing.", "x"), ("null", None, "y")], "document_id string, text string, mark string"))
    rows, lists = A.atoms_of(frames, COLUMNS, ("mark",)), A.atom_lists(frames, COLUMNS, ("mark",))
    same = lambda a, b, cols: sorted(map(tuple, a.select(*cols).collect()), key=repr) == sorted(map(tuple, b.select(*cols).collect()), key=repr)
    assert same(rows, lists.select("mark", F.inline("atoms")), [*COLUMNS, "mark"])
    assert same(A.messages(rows, ["document_id"]), A.messages_of(lists), ["document_id", "message"])
    assert same(design.select_focal(rows, 7), design.select_focal_of(lists, 7), [*COLUMNS, "mark", "pi"])
    scored = rows.withColumn("score", (draw("score", F.col("document_id"), F.col("atom_id")) % 1000 - 200) / 1000)
    got = catalog.queries()["allocation"](spark, DATA).join(frames.select("document_id"), "document_id")
    assert same(interventions.allocate(scored, 60).withColumn("utility", F.round("utility", 9)), got, got.columns)


def test_a_review_shuffles_no_text(spark):
    plan = catalog.queries()["exclusion_rates"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    carried = plan.split("Exchange hashpartitioning(document_id", 1)[1].split("Project [", 1)[1].split("\n")[0]
    assert "_entangled" in carried and not re.search(r"(?:^|, | AS )text#\d+(?:, |\])", carried)
    rows = spark.createDataFrame([("a", "5%", "numeric", 1, 3, "5%", "-5%", "accepted")], "document_id string, canonical_value string, role string, char_start int, char_end int, surface_form string, text string, verification string")
    assert validation.exclusion_reasons(rows).first()["exclusion_reason"] == "entangled_surface"
