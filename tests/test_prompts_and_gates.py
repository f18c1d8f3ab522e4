"""Prompts, masked contexts, answers' worth, reproduction gates, manuscript checks and trees."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import manuscript
from tessera.operators import benchmark, learning, prompts


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_prompts_hold_note_question_and_format(spark):
    role, subject, attribute = F.lit("period"), F.lit("Cust7"), F.lit("margin")
    text = one(spark, prompts.receiver_prompt(F.lit(" - period: FY1996 "), role, subject, attribute))[0]
    assert "--- HANDOFF NOTE ---\n- period: FY1996\n--- END NOTE ---" in text and "For Cust7, which reporting period" in text and text.endswith("Answer:")
    assert prompts.NO_NOTE in one(spark, prompts.no_evidence_prompt(role, subject, attribute))[0]
    assert "HANDOFF NOTE" not in one(spark, prompts.prior_probe_prompt(role, subject, attribute))[0]
    assert one(spark, prompts.question(F.lit("none"), subject, attribute))[0] is None


@pytest.mark.parametrize(("role", "want"), [("scope", "Europe"), ("period", "FY2000"), ("numeric", "unknown")])
def test_mock_answers(spark, role, want):
    prior = F.create_map(F.lit("period"), F.lit("FY2000"))
    assert one(spark, prompts.mock_answer(F.lit("- entity: A\n - scope:  Europe \nx"), F.lit(role), prior))[0] == want


def test_masked_context():
    text = "Intro.  Margin was 6.2% and\nalso 6.20 % here. Next 6.2%."
    start = text.index("6.2%")
    assert prompts.masked_context(text, "6.2%", "numeric", start, start + 4) == "Margin was <TARGET> and also <EQUIV_REDACTED> here."
    long = "a " * 400 + "FY2023" + " b" * 400
    at = long.index("FY2023")
    got = prompts.masked_context(long, "FY2023", "period", at, at + 6)
    assert got.count("<TARGET>") == 1 and len(got) <= 2 * prompts.WINDOW_CHARS + len(prompts.TARGET)
    assert prompts.masked_context("x", "x", "scope", 3, 4) == prompts.UNRESOLVED


def test_chance_needs_two_values(spark):
    assert one(spark, prompts.k_effective(F.lit(5)))[0] == 4
    with pytest.raises(Exception, match="two values"):
        one(spark, prompts.k_effective(F.lit(1)))


def test_leaks_are_found_in_their_own_document(spark):
    payloads = spark.createDataFrame([("d", "About ALDER ridge"), ("e", "nothing")], "document_id string, payload string")
    focals = spark.createDataFrame([("d", "Alder Ridge"), ("e", "Alder Ridge"), ("d", " ")], "document_id string, value string")
    assert [tuple(r) for r in prompts.leaks(payloads, focals).collect()] == [("d", "Alder Ridge")]


def test_reproduction_gate(spark):
    steps = F.create_map(*(x for s in benchmark.GATE_STEPS for x in (F.lit(s), F.lit(True))))
    rows = [("ok", "dev", 48.5, 50.0, None, None), ("off", "dev", 45.0, 50.0, None, None), ("inside", "dev", 45.0, 50.0, 44.0, 46.0), ("none", "dev", None, 50.0, None, None)]
    runs = spark.createDataFrame(rows, "method string, split string, observed double, expected double, interval_low double, interval_high double").withColumn("steps", steps)
    got = {r.method: r.status for r in benchmark.reproduction_verdicts(runs).collect()}
    assert got == {"ok": "READY", "off": "UNREPRODUCED", "inside": "READY", "none": "UNREPRODUCED"}
    with pytest.raises(AssertionError):
        benchmark.reproduction_verdicts(runs.withColumn("split", F.lit("sealed-test")))


def test_handoffs_keep_their_budget(spark):
    frames = spark.createDataFrame([("d", "one two three four five"), ("e", "")], "document_id string, text string")
    got = {(r.document_id, r.method): (r.output_tokens, r.within_budget) for r in benchmark.handoffs(frames, 3).collect()}
    assert got == {("d", "full_context"): (5, False), ("d", "head_truncation"): (3, True), ("e", "full_context"): (0, True), ("e", "head_truncation"): (0, True)}


def test_config_hash_ignores_order(spark):
    a, b = F.create_map(*map(F.lit, ("x", "1", "y", "2"))), F.create_map(*map(F.lit, ("y", "2", "x", "1")))
    row = one(spark, benchmark.config_hash(a).alias("a"), benchmark.config_hash(b).alias("b"))
    assert row.a == row.b


def test_manuscript_checks(spark):
    tex = r"\label{fig:a} see \ref{fig:a} and \ref{tab:b}, \tbd" + "\nStage S07 spend ceiling"
    df = spark.createDataFrame([("m", tex, '<svg><text x="1">Hi</text><title> T </title></svg>')], "file string, text string, svg string")
    assert [r.label for r in manuscript.reference_gaps(df, "file", "text").collect()] == ["tab:b"]
    assert manuscript.placeholder_counts(df, "file", "text").first().n_placeholders == 1
    assert {(r.line_number, r.term) for r in manuscript.language_violations(df, "file", "text", ("spend ceiling",)).collect()} == {(2, "spend ceiling"), (2, "S07")}
    assert df.select(manuscript.visible_svg_text(F.col("svg"))).first()[0] == "Hi\nT"
    assert one(spark, manuscript.latex_escape(F.lit("a_b & 5%")))[0] == r"a\_b \& 5\%"
    assert one(spark, manuscript.shown_interval(F.lit(0.5), F.lit(0.25), F.lit(0.75), 2), manuscript.shown(F.lit(None).cast("double")))[:] == ("0.50 [0.25, 0.75]", "---")
