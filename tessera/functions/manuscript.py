"""Checks of manuscript text: operational language, references, placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Stage names that must not be printed.
STAGE_NAMES = r"\bS(?:0[0-9]|1[01])\b"
LABEL, REFERENCE, PLACEHOLDER = r"\\label\{([^}]*)\}", r"\\(?:ref|autoref|cref)\{([^}]*)\}", r"\\tbd\b"


def language_violations(files: DataFrame, key: str, text: str, terms: tuple[str, ...]) -> DataFrame:
    """(key, line_number, term): terms in a line, case aside, and the first stage name of each line."""
    lines = files.select(key, F.posexplode(F.split(text, "\r\n|\n|\r")).alias("_i", "_line"))
    found = F.array(*(F.when(F.lower("_line").contains(t), F.lit(t)) for t in terms), F.nullif(F.regexp_extract("_line", STAGE_NAMES, 0), F.lit("")))
    return lines.select(key, (F.col("_i") + 1).alias("line_number"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("term"))


def visible_svg_text(svg: Column) -> Column:
    """Text of text, tspan, title and desc elements, one line each."""
    parts = F.regexp_extract_all(svg, F.lit(r"(?s)<(?:\w+:)?(?:text|tspan|title|desc)\b[^>]*>([^<]*)"), F.lit(1))
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def reference_gaps(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label): labels that are referred to and nowhere set."""
    set_labels = files.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(LABEL), F.lit(1))).alias("label")).distinct()
    used = files.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(REFERENCE), F.lit(1))).alias("label")).distinct()
    return used.join(set_labels, "label", "left_anti").select(key, "label")


def placeholder_counts(files: DataFrame, key: str, text: str) -> DataFrame:
    return files.select(key, F.regexp_count(F.col(text), F.lit(PLACEHOLDER)).alias("n_placeholders"))


def latex_escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([&%$#_{}])", r"\\$1")


def shown(value: Column, places: int = 3) -> Column:
    """A number to so many places, a dash for null."""
    return F.coalesce(F.format_number(value, places), F.lit("---"))


def shown_interval(point: Column, low: Column, high: Column, places: int = 3) -> Column:
    return F.when(point.isNull(), "---").otherwise(F.concat(shown(point, places), F.lit(" ["), shown(low, places), F.lit(", "), shown(high, places), F.lit("]")))
