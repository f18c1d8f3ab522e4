"""A message's names are found without listing its words, and facts are asked where their text is."""

from __future__ import annotations

import re

import pytest

from tessera.functions import atoms as A, lexicon as L, matching as M
from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_names_need_no_list_of_words(monkeypatch):
    listed = []
    words = M._words
    monkeypatch.setattr(M, "_words", lambda text: listed.append(text) or words(text))
    text = "Asia Pacific rose; Asia  pacific, xAsia Pacific, Asia Pacifics, ASIA-Pacific."
    assert M.Reading(text).spans("Asia Pacific", "scope") == [(0, 12), (19, 32)]
    assert M.Reading("A_Note 7, Note 71; note\n7").spans("Note 7", "provenance") == [(19, 25)]
    assert listed == []


@pytest.mark.parametrize("text", ["Asia Pacific rose, asia  PACIFIC and (Asia Pacific).", "-Note 7 Note 7 7", "A&B A & B a&b_ A&Bc"])
@pytest.mark.parametrize("value", ["Asia Pacific", "Note 7", "A&B", "-", "7", ""])
def test_both_ways_of_finding_names_agree(text, value):
    listed = M.Reading(text)
    listed._low = None  # as in a text beyond ASCII
    assert M.Reading(text).spans(value, "scope") == listed.spans(value, "scope")


def test_numbers_and_periods_are_found_as_by_the_plain_patterns():
    number = re.compile(rf"(?:\$|usd|eur|gbp|£|€)?\s*-?\d[\d,]*(?:\.\d+)?\s*(?:\|)?\s*(?:%|percent|pct|{L.UNITS})?", re.I)
    period = re.compile(r"(?<!\w)(?:fy\s*\d{4}(?:\s*q[1-4])?|q[1-4]\s*(?:of\s*)?(?:fy)?\s*\d{4}|fiscal\s+(?:year\s+)?\d{4}|(?:first|second|third|fourth)\s+quarter\s+of\s+(?:fiscal\s+)?\d{4})(?!\w)", re.I)
    text = "uSD 5, gbp-3.50 mm, 12|million 7 PCT xeur 9 $ -1,200.5k FY 2024 q3 xfy2024 Q1 of FY2020 Fiscal year 1999 ſecond quarter of fiscal 2001 -- $x 3%"
    for plain, quick in ((number, L.NUMERIC_SPAN), (period, L.PERIOD_SPAN)):
        assert [m[0].strip() for m in quick.finditer(text)] == [m[0].strip() for m in plain.finditer(text)]


def test_messages_are_not_copied_to_every_fact(spark):
    plan = catalog.queries()["transmitted"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1


def test_facts_are_asked_against_their_frames_text(spark):
    frames = spark.createDataFrame([("a", "Rose 5% in Europe.", "5 percent"), ("b", "Fell 6%.", None)], "document_id string, text string, message string")
    found = A.atoms_of(frames, ("canonical_value",), ("document_id",), {"said": A.Asked("message", M.said)}).collect()
    assert sorted(map(tuple, found)) == [("5%", "a", 1), ("6%", "b", None), ("Europe", "a", 0)]
