"""The rows that figures are drawn from: points, bands and series. An empty result stays empty; whoever draws decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: The least effect that a contrast is held against.
GATE = 0.10
#: Documents that are tried for a gallery before all are.
FIRST_AT_MOST = 2_000


def selection_bias_points(decomposition: DataFrame, label: str) -> DataFrame:
    """(label, x, y, bias): what an observer of failures sees against the whole; rows without failures have no point."""
    rows = decomposition.where(F.col("r_bar_zero").isNotNull() & F.col("r_observational").isNotNull())
    return rows.select(F.col(label).alias("label"), F.col("r_bar_zero").alias("x"), F.col("r_observational").alias("y"), (F.col("r_observational") - F.col("r_bar_zero")).alias("bias"))


def dose_points(dose: DataFrame, order: tuple[str, ...] = ("low", "medium", "high")) -> DataFrame:
    """(place, bin, mean, n) of each bin with a mean, in their order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("bin"))
    return dose.where("mean IS NOT NULL").select(place.cast("int").alias("place"), "bin", "mean", "n")


def contrast_bars(estimates: DataFrame, label: str) -> DataFrame:
    """(label, point, below, above, clears): a point with how far its interval reaches either way, for what can be estimated."""
    rows = estimates.where("estimate IS NOT NULL")
    return rows.select(F.col(label).alias("label"), F.col("estimate").alias("point"), (F.col("estimate") - F.col("lower")).alias("below"), (F.col("upper") - F.col("estimate")).alias("above"), (F.col("estimate") >= GATE).alias("clears"))


def placebo_bands(regions: DataFrame, bounds: list[float]) -> DataFrame:
    """(mechanism, epsilon_bar, lower, upper): each mechanism's region as its assumed bound grows."""
    wide = regions.select("mechanism", "point_corrected", F.explode(F.array(*map(F.lit, sorted(bounds)))).alias("epsilon_bar"))
    clipped = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    return wide.select("mechanism", "epsilon_bar", clipped(F.col("point_corrected") - F.col("epsilon_bar")).alias("lower"), clipped(F.col("point_corrected") + F.col("epsilon_bar")).alias("upper"))


def allocation_points(candidates: DataFrame) -> DataFrame:
    """(x, y, n): budget-neutral surplus against transmission, equal points counted."""
    return candidates.groupBy(F.col("delta_budget").alias("x"), F.col("transmitted").alias("y")).agg(F.count("*").alias("n"))


def depth_series(decomposition: DataFrame, method: Column) -> DataFrame:
    """(method, hop, fidelity, transmission): both curves of a chain of handoffs, never the one without the other."""
    return decomposition.where("endpoint_fidelity IS NOT NULL AND t_bar IS NOT NULL").select(method.alias("method"), "hop", F.col("endpoint_fidelity").alias("fidelity"), F.col("t_bar").alias("transmission"))


def gallery(edits: DataFrame, n: int = 6) -> DataFrame:
    """The first n accepted edits by document and role: the natural message beside the other arm."""
    shown = edits.where("edit.accepted").select("document_id", "role", "canonical_value", F.col("message").alias("natural"), F.col("edit.text").alias("other"), "edit.mechanism")
    return shown.orderBy("document_id", "role", "canonical_value").limit(n)


def gallery_of(documents: DataFrame, edits_to: Callable[[str | None], DataFrame], n: int = 6) -> DataFrame:
    """gallery() of edits_to(None), the edits of all documents (document_id), of which only the first are made where they give n.

    edits_to(last): the edits of the documents up to that one in their order.
    Where the first documents give fewer than n, four times as many are tried, and soon all.
    """
    ids, most = documents.select("document_id").where("document_id IS NOT NULL"), n
    while True:
        last, met = ids.orderBy("document_id").limit(most).agg(F.max("document_id"), F.count("*")).first()
        last = last if met == most and most <= FIRST_AT_MOST else None
        shown = gallery(edits_to(last), n)
        rows = shown.collect()
        if len(rows) == n or last is None:
            return documents.sparkSession.createDataFrame(rows, shown.schema)
        most *= 4
