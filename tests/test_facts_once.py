"""Facts are found once in a query, whatever reads them, and in pieces of a batch."""

from __future__ import annotations

import random
import re

import pytest

from tessera.functions import atoms as A, lexicon as L, matching as M, text as T
from tessera.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["skeleton_pairs", "mock_receiver", "exclusion_rates", "transmitted", "eligibility_reasons", "frame_containment"])
def test_facts_are_found_once(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_both_sides_of_a_review_read_the_same_facts(spark):
    reviewed = catalog.queries()["review_applied"](spark, DATA)
    reviewed.collect()
    plan = reviewed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan


def test_kept_columns_stay_with_their_atoms(spark):
    frames = spark.createDataFrame([("a", "Rose 5% in Europe.", "x"), ("b", None, "y"), ("c", "Nothing.", "z"), ("d", "Fell 6%.", None)], "document_id string, text string, mark string")
    found = A.atoms_of(frames, ("document_id", "canonical_value"), ("mark",)).collect()
    assert sorted(map(tuple, found), key=repr) == [("a", "5%", "x"), ("a", "Europe", "x"), ("d", "6%", None)]


def test_batches_are_held_in_pieces():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(T.pieces([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) == T.PIECE_ROWS and [v for p in parts for v in p.column(0).to_pylist()] == list(range(1000))


def test_nothing_is_looked_for_after_the_last_ending():
    class Counted:
        def __init__(self):
            self.searches = 0

        def search(self, text, at):
            self.searches += 1
            return L.ENTITY.search(text, at)

    counted = Counted()
    rule = A.Rule("entity", "", counted, lambda g: g[0], end=L.ENTITY_END)
    assert [m[1] for m in rule.matches("Acme Corp rose. Big Old Group fell. Then Nothing Else Happened.", "")] == ["Acme Corp", "Big Old Group"]
    assert counted.searches == 2


def test_first_letters_of_patterns_have_no_other_case():
    for letter in "UEFQ":
        assert {c for c in map(chr, range(0x110000)) if re.fullmatch(letter, c, re.I)} == {letter, letter.lower()}


def test_a_knot_of_spans_is_untied_alone():
    spans = [("numeric", 0, 4), ("period", 3, 9), ("scope", 8, 10), ("entity", 12, 14), ("scope", 14, 15)]
    found = [A.Found(r, a, b, "v", "") for r, a, b in spans]
    assert [(f.start, f.end) for f in A.without_overlaps(found)] == [(3, 9), (12, 14), (14, 15)]


def test_an_edited_message_is_read_once():
    M.read.cache_clear()
    M.outcome("Margin 5% in Europe.", "5%", "numeric", "- numeric: 5%", 60)
    assert M.read.cache_info().misses == 2 and M.mend("a  b ( c ) , , d .") == "a b (c), d."


def test_columns_hold_a_piece_at_a_time():
    import pyarrow as pa

    held = []

    class Values:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            held.append(len(self.values[at : at + n]))
            return pa.array(self.values[at : at + n], pa.string())

    texts = [None if i % 7 == 0 else f"a  {i}" for i in range(600)]
    got = T.in_pieces(T.normalize, Values(texts), pa.string()).to_pylist()
    assert max(held) == T.PIECE_ROWS and got == [None if t is None else T.normalize(t) for t in texts]
    assert T.in_pieces(T.normalize, pa.array([], pa.string()), pa.string()).to_pylist() == []


def test_numbers_are_written_as_the_double_next_to_them():
    for digits in ("0", "00.50", "1,234.5600", "99999999999.9999", "123456789012.345", "0.00005", "0.00004", "2.99995", "1٢.5"):
        whole, _, rest = f"{float(digits.replace(',', '')):.4f}".partition(".")
        assert A.decimals(digits) == (f"{whole}.{rest.rstrip('0')}" if rest.rstrip("0") else whole)


def test_a_review_shuffles_identifiers_only(spark):
    plan = catalog.queries()["review_applied"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    shuffled = plan.split("Exchange hashpartitioning(atom_id", 1)[1].split("MapInArrow", 1)[0]
    assert "Project [concat_ws(|, document_id" in shuffled and shuffled.count("Project") == 1


def test_facts_of_many_texts_are_those_of_each_alone():
    """One search of all texts at once finds what each text has by itself, whatever stands at its ends."""
    bits = [
        " ", ".", ",", "-", "\n", "\0", "%", "é", "Ⅷ", "٣", "n", "7", "12%", "3,000.50 %", "$12,410.90 million", "€5bn", "usd 7 k", "FY1995", "Q2 FY1995", "second quarter of fiscal 2001",
        "Note 5", "Part IV", "Acme & Co.", "Cust12 Holdings", "Inc.", "Group", "Europe", "Asia Pacific", "Retail Group", "Europe Holdings", "5",
    ]
    draw = random.Random(3)
    texts = ["".join(draw.choice(bits) + draw.choice(["", " "]) for _ in range(draw.randrange(1, 12))) for _ in range(600)]
    many = A._Texts([str(i) for i in range(len(texts))], texts, ("spans",))
    got = list(zip(many.of.tolist(), many.roles, many.values, many.subtypes, many.spans()))
    want = []
    for i, text in enumerate(texts):
        places: dict = {}
        for f in A.without_overlaps(A.candidates(text)):
            places.setdefault((f.role, f.value), (f.subtype, []))[1].append({"start": f.start, "end": f.end})
        want += [(i, role, value, subtype, spans) for (role, value), (subtype, spans) in places.items()]
    assert got == want and len(want) > 1000


def test_plain_texts_are_counted_and_mended_like_others():
    """The short ways of ASCII texts give what the patterns give."""
    draw = random.Random(4)
    for _ in range(3000):
        text = "".join(draw.choice([" ", "  ", ".", ",", "%", "(", ")", "[", '"', "\n", "\x1c", "a", "B1", "_", ", ", " ( ) ", "USD 5", "7%", "Note 2", "Europe 7"]) for _ in range(draw.randrange(12)))
        assert T.count_tokens(text) == len(re.findall(L.TOKEN, text))
        mended = text
        for _ in range(L.MENDING_PASSES):
            if L.TO_MEND.search(mended):
                for pattern, to in L.MENDINGS:
                    mended = pattern.sub(to, mended)
        assert M.mend(text) == mended.strip()
        assert M.Reading(text)._plain_words == " " + " ".join(re.findall(L.TOKEN, M.plain(text))) + " "
        assert [m.span() for m in M.Reading(text)._scanned("numeric").finditer(text)] == [m.span() for m in L.NUMERIC_SPAN.finditer(text)]
