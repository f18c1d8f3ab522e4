"""Checks of finished figures and manuscripts: what is missing, unreadable or still to be filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.manuscript import LABEL, PLACEHOLDER, language_violations, visible_svg_text

#: The least size of printed letters in points, and points of a pixel.
FONT_FLOOR, POINTS_OF_PIXEL = 6.0, 0.75
#: Fixed patterns: sizes as attributes and in styles, one size with its unit, figures' beginning and end, a placeholder for a figure, what a build log says of open references.
SIZE_ATTRIBUTE, SIZE_STYLE, SIZE = r"""(?i)font-size\s*=\s*["']([^"']+)["']""", r"(?i)font-size\s*:\s*([0-9]+(?:\.[0-9]+)?(?:pt|px)?)", r"^\s*([0-9]+(?:\.[0-9]+)?)(pt|px)?\s*$"
FIGURE_BEGIN, FIGURE_END, FIGURE_PLACEHOLDER = r"\\begin\{figure\*?\}", r"\\end\{figure\}", r"\\phfig\b"
UNDEFINED = r"(Citation .* undefined|Reference .* undefined|LaTeX Warning: There were undefined)"


def read_figures(spark: SparkSession, folder: str) -> DataFrame:
    """(figure_id, pdf_bytes, svg): figures of a folder, paired by their names; nulls for what is not there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,svg}").load(folder)
    stem = F.regexp_extract("path", r"([^/]*)\.(?:pdf|svg)$", 1).alias("figure_id")
    pdf = files.where(F.endswith("path", F.lit(".pdf"))).select(stem, F.col("length").alias("pdf_bytes"))  # contents stay unread
    svg = files.where(F.endswith("path", F.lit(".svg"))).select(stem, F.col("content").cast("string").alias("svg"))
    return pdf.join(svg, "figure_id", "full_outer")


def font_sizes(svg: Column) -> Column:
    """All letter sizes of attributes and styles, in points; those in other units do not count."""
    found = F.concat(F.regexp_extract_all(svg, F.lit(SIZE_ATTRIBUTE), F.lit(1)), F.regexp_extract_all(svg, F.lit(SIZE_STYLE), F.lit(1)))
    sizes = F.filter(found, lambda s: s.rlike(SIZE))
    return F.transform(sizes, lambda s: F.regexp_extract(s, SIZE, 1).cast("double") * F.when(F.lower(F.regexp_extract(s, SIZE, 2)) == "px", POINTS_OF_PIXEL).otherwise(1.0))


def figure_problems(figures: DataFrame, terms: tuple[str, ...], floor: float = FONT_FLOOR) -> DataFrame:
    """(figure_id, severity, problem, item) of figures (figure_id, pdf_bytes, svg); a sound figure has no row.

    A figure that lacks a file, or whose file is empty, is not looked into. A
    drawing that is no well-formed XML is still searched for small letters and
    for operational language.
    """
    lacking = {"pdf missing or empty": F.coalesce("pdf_bytes", F.lit(0)) == 0, "svg missing or empty": F.coalesce(F.length("svg"), F.lit(0)) == 0}
    whole = ~lacking["pdf missing or empty"] & ~lacking["svg missing or empty"]
    parsed = F.from_xml(F.when(whole, F.col("svg")), "_viewBox string, _width string, _height string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    seen = figures.select("figure_id", "pdf_bytes", "svg", parsed.alias("_x"), F.array_min(font_sizes(F.col("svg"))).alias("_least"))
    broken = F.col("_x._corrupt").isNotNull()
    unsized = (F.coalesce("_x._viewBox", F.lit("")) == "") & ((F.coalesce("_x._width", F.lit("")) == "") | (F.coalesce("_x._height", F.lit("")) == ""))
    one = lambda when, severity, problem, item=None: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(problem).alias("problem"), (F.lit(None) if item is None else item).cast("string").alias("item")))
    found = F.array(
        *(one(when, "failure", name) for name, when in lacking.items()), one(whole & broken, "failure", "not well-formed"),
        one(whole & ~broken & unsized, "warning", "no viewBox and no width and height"), one(whole & (F.col("_least") < floor), "failure", "letters below the floor", F.format_number("_least", 1)),
    )
    rows = seen.select("figure_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_p")).select("figure_id", "_p.*")
    said = language_violations(figures.where(whole).select("figure_id", visible_svg_text(F.col("svg")).alias("_said")), "figure_id", "_said", terms)
    return rows.unionByName(said.select("figure_id", F.lit("failure").alias("severity"), F.lit("operational language").alias("problem"), F.concat_ws(":", F.col("line_number").cast("string"), "term").alias("item")))


def placeholder_labels(tex: Column) -> Column:
    """Labels of the figures of a manuscript that still hold a placeholder."""
    blocks = F.split(tex, FIGURE_BEGIN)
    bodies = F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks), F.lit(1))), lambda b: F.element_at(F.split(b, FIGURE_END), 1))
    open_ones = F.filter(bodies, lambda b: b.rlike(FIGURE_PLACEHOLDER))
    return F.array_distinct(F.flatten(F.transform(open_ones, lambda b: F.regexp_extract_all(b, F.lit(LABEL), F.lit(1)))))


def manuscript_problems(manuscripts: DataFrame, targets: DataFrame, present: DataFrame, traced: DataFrame, static: DataFrame) -> DataFrame:
    """(manuscript, severity, problem, item) of manuscripts (manuscript, tex, log); a finished one has no failure.

    targets: (label, file, kind), the file that fills each labelled table or
    figure; present: (file) those there are; traced: (file) those that the
    results manifest names; static: (label) of floats drawn by hand, whose
    placeholders are only a warning. A null log is not looked at.
    """
    labels = manuscripts.select("manuscript", F.explode(F.array_distinct(F.regexp_extract_all("tex", F.lit(LABEL), F.lit(1)))).alias("label"))
    static = static.select("label").distinct().withColumn("_static", F.lit(True))
    row = lambda df, severity, problem, item: df.select("manuscript", (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), (problem if isinstance(problem, Column) else F.lit(problem)).alias("problem"), item.cast("string").alias("item"))
    counted = manuscripts.withColumns({"_tbd": F.regexp_count("tex", F.lit(PLACEHOLDER)), "_open": F.regexp_count("log", F.lit(UNDEFINED))})
    held = manuscripts.select("manuscript", F.explode(placeholder_labels(F.col("tex"))).alias("label")).join(static, "label", "left")
    by_hand = F.col("_static").isNotNull()
    needed = labels.join(targets, "label").join(present.select("file").distinct().withColumn("_there", F.lit(True)), "file", "left")
    untraced = needed.where("_there").join(traced.select("file").distinct(), "file", "left_anti")
    parts = [
        row(counted.where("_tbd > 0"), "failure", "unfilled values", F.col("_tbd")),
        row(held, F.when(by_hand, "warning").otherwise("failure"), F.when(by_hand, "figure drawn by hand").otherwise("figure placeholder"), F.col("label")),
        row(needed.where("_there IS NULL"), "failure", F.concat(F.lit("missing "), F.col("kind")), F.col("file")),
        row(untraced, "failure", F.concat(F.lit("untraced "), F.col("kind")), F.col("file")),
        row(counted.where("_open > 0"), "failure", "undefined references", F.col("_open")),
        row(manuscripts.where(F.contains("log", F.lit("??")) & F.contains("log", F.lit("LaTeX Warning"))), "warning", "question marks in the log", F.lit(None)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
