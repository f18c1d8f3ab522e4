"""Canonical forms, presence, edits, facts, frames and scans."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import atoms as A, matching as M, text as T


@pytest.mark.parametrize("value", ["6.2%", "6.20 %", "6.2 percent", "6.2pct"])
def test_percent_forms(value):
    assert M.canonical(value, "numeric") == "6.2%"


@pytest.mark.parametrize(("value", "role", "want"), [
    ("$1.5 billion", "numeric", "USD1500000000"), ("USD 1,500,000,000", "numeric", "USD1500000000"), ("$127.2|million", "numeric", "USD127200000"),
    ("fiscal year 2023", "period", "FY2023"), ("Q1 of FY 2023", "period", "FY2023Q1"), ("the first quarter of 2023", "period", "FY2023Q1"), ("in 2024", "period", "FY2024"),
    ("note  7", "provenance", "Note 7"), ("Alder  Group", "entity", "alder group"),
])
def test_canonical(value, role, want):
    assert M.canonical(value, role) == want


@pytest.mark.parametrize(("message", "value", "role", "want"), [
    ("margin rose 62.5%", "6.2%", "numeric", False), ("margin rose 6.20 %", "6.2%", "numeric", True), ("results for FY20231", "FY2023", "period", False),
    ("results for fiscal 2023", "FY2023", "period", True), ("Alderman Group reported", "alder", "entity", False), ("ABC Corp", "AB", "entity", False),
    ("revenue was $127.2 million in FY2024", "$127.2|million", "numeric", True), ("see Note 12", "Note 1", "provenance", False),
])
def test_transmitted(message, value, role, want):
    assert M.read(message).says(value, role) is want


def test_delete_removes_every_form():
    edit = M.edit("delete", "Margin rose 6.2% in Europe, and 6.20 % overall.", "6.2%", "numeric")
    assert edit.accepted and edit.occurrences == 2 and not M.find_spans(edit.text, "6.2%", "numeric") and "Europe" in edit.text


def test_refusals_are_rows():
    assert M.edit("delete", "nothing here", "6.2%", "numeric").reason == "absent"
    assert M.edit("delete", "rose from 6.2% to 7%", "6.2%", "numeric").reason == "entangled"
    assert M.edit("insert", "Margin 6.2%", "6.2%", "numeric", "- numeric: 6.2%").reason == "present"
    assert M.edit("insert", "Margin", "6.2%", "numeric", "- nothing").reason == "undetected"


def test_insert_overruns_and_round_trips():
    edit = M.edit("insert", "A note.", "FY2023", "period", "- period: FY2023", budget=3)
    assert edit.accepted and edit.overrun_tokens > 0 and edit.text.startswith("A note.\n")
    assert M.edit("delete", edit.text, "FY2023", "period").accepted


def test_shams_keep_the_value():
    assert M.edit("sham_delete", "Margin 6.2% up", "6.2%", "numeric", "6.20%").accepted
    assert M.edit("sham_delete", "Margin 6.2% up", "6.2%", "numeric", "7%").reason == "destroyed"
    assert M.edit("sham_insert", "Margin 6.2% up", "6.2%", "numeric", "- scope: Europe").accepted
    assert M.edit("sham_insert", "Margin", "6.2%", "numeric", "6.2%").reason == "availability_changed"


def test_columns_follow_the_functions_and_keep_nulls(spark):
    rows = [("Margin 6.2% up in Europe", "6.2%", "numeric", "- numeric: 6.2%"), ("Margin", "6.2%", "numeric", "- numeric: 6.2%"), (None, "x", "scope", "l"), ("m", None, "scope", "l"), ("m", "v", None, "l"), ("see EMEA.", "EMEA", "scope", None)]
    df = spark.createDataFrame(rows, "m string, v string, r string, x string")
    got = M.outcomes(df, "m", "v", "r", "x", 60).collect()
    for row, g in zip(rows, got):
        if None in row:
            assert (g.transmitted, g.edit, g.natural, g.other) == (None, None, None, None)
        else:
            want = M.outcome(*row, 60)
            assert (g.transmitted, g.edit.text, g.edit.reason, g.natural, g.other) == (want.transmitted, want.edit.text, want.edit.reason, want.natural, want.other)
    some = df.withColumn("t", M.transmitted_col("m", "v", "r")).withColumn("e", M.counterfactual_col("m", "v", "r", "t", "x", 60)).withColumn("a", M.recovered_col("m", "v", "r"))
    found = some.select("*", M.canonical_col("v", "r").alias("c"), M.spans_col("m", "v", "r").alias("s"), M.sham_col("sham_insert", "m", "v", "r", "x").alias("sham")).collect()
    for row, f, g in zip(rows, found, got):
        assert f.t == (None if None in row[:3] else int(M.read(row[0]).says(*row[1:3]))) and f.a == (None if None in row[:3] else g.natural if None not in row else 1)
        assert (f.e is None or f.e.accepted is None) == (None in row) and (f.e.text if f.e else None) == (g.edit.text if g.edit else None)
        assert (f.s is None) == (None in row[:3]) and (f.sham is None or f.sham.accepted is None) == (None in row)
    assert found[0].c == "6.2%" and [tuple(x) for x in found[0].s] == [(7, 11)]


def test_atoms_cover_five_roles_and_merge():
    text = "Cust7 Holdings reported results for FY1996. Europe segment margin improved by 5%. Charges were $1,234.50 million in Q2 FY1996. See Note 3 to the statements. Margin improved by 5%."
    got = {(a["role"], a["canonical_value"]): a for a in A.atomize("d", text)}
    assert set(got) == {("entity", "Cust7 Holdings"), ("period", "FY1996"), ("period", "FY1996Q2"), ("scope", "Europe"), ("numeric", "5%"), ("numeric", "$1234.5|million"), ("provenance", "Note 3")}
    five = got["numeric", "5%"]
    assert five["occurrence_count"] == 2 and all(text[a["char_start"] : a["char_end"]] == a["surface_form"] for a in got.values())
    assert A.atomize("d", "") == []


def test_longest_span_wins():
    found = A.without_overlaps(list(A.candidates("in Q2 FY1996")))
    assert [f.value for f in found] == ["FY1996Q2"]


def test_normal_form_is_idempotent():
    raw = "  A “b”­  c \r\n\r\n\r\n\r\nd–e\t f  "
    once = T.normalize(raw)
    assert once == 'A "b" c\n\n\nd-e f'.replace("\n\n\n", "\n\n") and T.normalize(once) == once


def test_sentences_and_sections():
    text = 'One. Two! (Three) 3.5 is. "Four"'
    assert [text[a:b] for a, b in T.sentences(text)] == ["One.", "Two!", "(Three) 3.5 is.", '"Four"']
    body = "x" * 600
    text = f"Item 7. Management's Discussion and Analysis ... Item 8. Financial Statements\nItem 7. Management's discussion and analysis {body} Item 7A. Quantitative"
    a, b = T.discussion_section(text)
    assert body in text[a:b]
    assert T.discussion_section("Item 7. Management's Discussion and Analysis short") is None


def test_frames_hash_their_exact_text(spark):
    docs = spark.createDataFrame([("d", "One two three. " * 9), ("e", ""), ("n", None)], "document_id string, text string")
    rows = {r.document_id: r for r in T.source_frames(docs, 5).collect()}
    assert rows["d"].truncated and rows["d"].token_count == 5 and rows["d"].sha256 == hashlib.sha256(rows["d"].text.encode()).hexdigest()
    assert rows["e"].token_count == 0 and "n" not in rows


def test_native_truncation_matches_python(spark):
    texts = ["", "a", "a b, c!", "Ünï cödé 12.5% — ok", " lead  and   trail ", "x" * 300 + " y z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for most in (0, 1, 3, 50):
        got = df.select(T.head_tokens(F.col("text"), most).alias("h"), T.token_count(F.col("text")).alias("n"), "text").collect()
        assert all(r.h == T.truncate(r.text, most)[0] and r.n == T.count_tokens(r.text) for r in got)


def test_html():
    assert T.html_to_text("<html><script>x</script><body><p>A &amp; b</p>\n <p> c </p><style>y</style></body>") == "A & b\nc"


def test_redaction_and_scan(spark):
    df = spark.createDataFrame([("f", "key sk-abcdefghijklmnopqrstuvwx\nmail me@corp.example\nuser@example.com\n/home/bob/x")], "file string, text string")
    assert "sk-abc" not in df.select(T.redact(F.col("text"))).first()[0]
    rules = {(r.line_number, r.rule) for r in T.line_findings(df, "file", "text").collect()}
    assert rules == {(1, "openai_key"), (2, "email_address"), (4, "absolute_home_path")}
    pairs = spark.sql("SELECT map('api_key', 'x', 'note', 'Bearer abcdefghijklmnopqrst') AS m").select(T.redact_map(F.col("m")).alias("m")).first().m
    assert pairs == {"api_key": "[REDACTED]", "note": "[REDACTED]"}
