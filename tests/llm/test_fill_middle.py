"""Fill-in-the-middle: cuts against walking the units, exact round trips, odd input."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import fill_middle as M, queries as Q
from tests.conftest import SF
from tests.llm.test_edges import CLASHING

UNITS = {"line": r"[^\n]*\n|[^\n]+", "run": r"[ \t-\r]+|[^ \t-\r]+", "char": r"(?s:.)"}


@pytest.mark.parametrize("unit", UNITS)
@settings(max_examples=200, deadline=None)
@given(text=st.text(st.sampled_from("ab \n\t\réß漢😀<P>"), max_size=40))
def test_offsets_equal_walked_units(unit, text):
    units = re.findall(UNITS[unit], text)
    runs = M.Runs(text.encode(), unit)
    assert runs.n == len(units)
    walked = ["".join(units[:j]).encode() for j in range(len(units) + 1)]
    assert [runs.offset(j) for j in range(len(units) + 1)] == [len(x) for x in walked]
    assert M.code_points(text.encode()) == len(text)


def expected(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(UNITS["line"], text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.fixture(scope="module")
def odd(spark):
    long = "".join(f"line {i} é\n" * (i % 3) + "\n" for i in range(60_000))
    texts = [None, "", "\n", "\n\n\n", "no end", "a\nb", "a\nb\n", "<P>", "x <S> y\nz", "x < P>\n<M", "<\nP>\n<\nS>\n<", long, "漢\n😀\n" * 50, "\r\nx\r\n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "a\nb"), (5, "a\nb"), (5, "other"), (None, "no\nid\n"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in [*CLASHING, "n", "form", "output", "_a", "_text"]})


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 100)])
def test_rows_equal_the_contract(odd, rate, spm):
    made = M.fill_in_middle(odd, rate=rate, spm=spm).withColumn("back", M.restored(F.col("output"), F.col("form")))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect()]
    want = [(r.doc_id, *expected(r.doc_id, r.text, rate, spm), r.text or "") for r in odd.select("doc_id", "text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table_and_unknown_unit(odd):
    assert M.fill_in_middle(odd.limit(0)).collect() == []
    with pytest.raises(ValueError):
        M.fill_in_middle(odd, unit="page")


@pytest.mark.parametrize("unit", ["run", "char"])
def test_other_units_round_trip(odd, unit):
    made = M.fill_in_middle(odd.where("doc_id <> 5"), unit=unit).withColumn("back", M.restored(F.col("output"), F.col("form")))
    texts = {r.doc_id: r.text or "" for r in odd.where("doc_id <> 5").select("doc_id", "text").collect()}
    rows = made.collect()
    assert {r.doc_id: r.back for r in rows} == texts
    assert all(r.n == len(re.findall(UNITS[unit], texts[r.doc_id])) for r in rows)


def test_query_restores_every_document(spark):
    got = Q.QUERIES["op13_fill_middle"](spark, SF)
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("of"))
    assert got.join(texts, "doc_id").where("restored_sha256 <> of").count() == 0
    assert got.count() == texts.count()
    assert {r.form for r in got.select("form").distinct().collect()} >= {"psm", "spm"}
