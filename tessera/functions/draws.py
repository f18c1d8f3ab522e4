"""Reproducible draws: 60 bits of a SHA-256, alike in Spark and in SQL engines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def draw(*parts: Column | str | int) -> Column:
    """A number in [0, 2^60) that depends on the parts' text alone."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(c.cast("string") for c in cols)), 256), 1, 15), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """The same number in DuckDB; parts are SQL expressions."""
    return f"CAST(concat('0x', substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 15)) AS BIGINT)"
