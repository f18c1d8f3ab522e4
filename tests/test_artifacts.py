"""Figures and manuscripts with each failure planted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import artifacts as A, figures

GOOD = '<?xml version="1.0"?>\n<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 9 9"><g style="font-size: 9px"><text font-size="8pt">Fine &amp; dandy</text></g></svg>'


@pytest.fixture
def folder(tmp_path):
    svgs = {
        "good": GOOD, "small": GOOD.replace("8pt", "5.5"), "pixels": GOOD.replace("9px", "7px"), "broken": GOOD.replace("</g>", ""), "unsized": GOOD.replace(' viewBox="0 0 9 9"', ' width="9"'),
        "sized": GOOD.replace('viewBox="0 0 9 9"', 'width="9" height="9"'), "said": GOOD.replace("Fine", "Spend ceiling of S07"), "empty": "", "units": GOOD.replace("8pt", "2em").replace("9px", "3em"),
    }
    for name, svg in svgs.items():
        (tmp_path / f"{name}.svg").write_text(svg)
        (tmp_path / f"{name}.pdf").write_bytes(b"" if name == "sized" else b"%PDF")
    (tmp_path / "alone.pdf").write_bytes(b"%PDF")
    (tmp_path / "lone.svg").write_text(GOOD)
    (tmp_path / "notes.txt").write_text("x")
    return str(tmp_path)


def test_each_failure_of_a_figure_is_told(spark, folder):
    got = {tuple(r) for r in A.figure_problems(A.read_figures(spark, folder), ("spend ceiling",)).collect()}
    assert got == {
        ("small", "failure", "letters below the floor", "5.5"), ("pixels", "failure", "letters below the floor", "5.2"), ("broken", "failure", "not well-formed", None), ("unsized", "warning", "no viewBox and no width and height", None),
        ("sized", "failure", "pdf missing or empty", None), ("empty", "failure", "svg missing or empty", None), ("alone", "failure", "svg missing or empty", None), ("lone", "failure", "pdf missing or empty", None),
        ("said", "failure", "operational language", "1:spend ceiling"), ("said", "failure", "operational language", "1:S07"), ("units", "failure", "letters below the floor", "3.0"),
    }


def test_each_failure_of_a_manuscript_is_told(spark):
    tex = r"""Value \tbd and \tbd{}, not \tbdx. \label{sec:one}
\begin{figure}\phfig \label{fig:hero}\end{figure}
\begin{figure*}\phfig{x} {\caption{a}\label{fig:open}} \end{figure}
\begin{figure}\label{fig:there}\end{figure} \phfig outside
\begin{table}\label{tab:gone}\end{table} \label{tab:there}"""
    rows = [("bad", tex, "LaTeX Warning: Reference `x' undefined\nLaTeX Warning: There were undefined references ??"), ("good", r"\label{tab:there}", "fine"), ("bare", "", None), ("none", None, None)]
    frame = spark.createDataFrame(rows, "manuscript string, tex string, log string")
    targets = spark.createDataFrame([("tab:gone", "gone.tex", "table"), ("tab:there", "there.tex", "table"), ("fig:there", "there.pdf", "figure"), ("fig:unused", "unused.pdf", "figure")], "label string, file string, kind string")
    present = spark.createDataFrame([("there.tex",), ("there.pdf",), ("there.pdf",)], "file string")
    traced = spark.createDataFrame([("there.tex",)], "file string")
    static = spark.createDataFrame([("fig:hero",)], "label string")
    got = sorted(tuple(r) for r in A.manuscript_problems(frame, targets, present, traced, static).collect() if r.item is not None or r.problem.startswith("question"))
    assert got == sorted([
        ("bad", "failure", "unfilled values", "2"), ("bad", "warning", "figure drawn by hand", "fig:hero"), ("bad", "failure", "figure placeholder", "fig:open"), ("bad", "failure", "missing table", "gone.tex"),
        ("bad", "failure", "untraced figure", "there.pdf"), ("bad", "failure", "undefined references", "2"), ("bad", "warning", "question marks in the log", None),
    ])


def test_a_gallery_makes_the_first_documents_only(spark, monkeypatch):
    """The first accepted edits are those of all documents; the rest is made only where they are too few."""
    rows = [(str(i), r, "v", "m", ("t" if i % 7 == 3 else None, "del", i % 7 == 3)) for i in range(40) for r in ("scope", "entity")]
    edits = spark.createDataFrame(rows, "document_id string, role string, canonical_value string, message string, edit struct<text: string, mechanism: string, accepted: boolean>")
    asked = []

    def edits_to(last):
        asked.append(last)
        return edits if last is None else edits.where(F.col("document_id") <= last)

    documents = edits.select("document_id").distinct()
    for n, tries in ((2, 2), (6, 2), (200, 1)):
        asked.clear()
        assert figures.gallery_of(documents, edits_to, n).collect() == figures.gallery(edits, n).collect()
        assert len(asked) == tries
    monkeypatch.setattr(figures, "FIRST_AT_MOST", 1)
    asked.clear()
    assert figures.gallery_of(documents, edits_to, 2).count() == 2 and asked == [None]
