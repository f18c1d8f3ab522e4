"""Joins by order and by overlap, in columns only, with long groups cut into stretches.

Positions are numbers (of characters, of microseconds). A group's positions are
cut into stretches of `width`, which are dealt out one by one, so that a group
with most of the rows is not one task's. `width` bears on cost only, never on a
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _stretch(at: Column | str, width: float) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.lit(width))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str], width: float, tolerance: float | None = None, forward: bool = False) -> DataFrame:
    """left with the columns `take` of the last row of right at or before its position in its group; nulls where there is none.

    forward: of the first row at or after it. tolerance: no farther than that.
    Of rows of right at one position the largest `take` counts. Rows of right
    with a null key or position meet nothing, and left rows with one keep
    nulls. Both sides go into one window a stretch; what a stretch begins with
    comes from the stretches before it, one row each.
    """
    sign = -1 if forward else 1
    names = [f"_k{i}" for i in range(len(by))]
    keys = [F.col(c).alias(n) for c, n in zip(by, names)]
    known = F.col("_asked").isNotNull()
    for n in names:
        known = known & F.col(n).isNotNull()
    group = [*names, "_stretch"]
    place = (F.col(at) * sign).alias("_asked")
    taken = F.struct((F.col(at) * sign).alias("_at"), *(F.col(c).alias(f"_t{i}") for i, c in enumerate(take)))
    found = right.select(*keys, place, taken.alias("_taken")).where(known).withColumn("_stretch", _stretch("_asked", width))
    asked = left.select(F.struct(*left.columns).alias("_row"), *keys, place).withColumn("_stretch", _stretch("_asked", width))
    # what each stretch that is asked for begins with
    last = found.groupBy(*group).agg(F.max("_taken").alias("_last"))
    wanted = asked.where(known).select(*group).distinct()
    along = W.partitionBy(*names).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    begins = wanted.join(last, group, "full_outer").withColumn("_carried", F.last("_last", ignorenulls=True).over(along)).select(*group, "_carried")
    # within a stretch: rows of right come before rows of left at one position
    sides = asked.withColumn("_side", F.lit(1)).unionByName(found.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    inside = W.partitionBy(*group).orderBy("_asked", "_side", "_taken").rowsBetween(W.unboundedPreceding, 0)
    met = sides.withColumn("_met", F.last("_taken", ignorenulls=True).over(inside)).where("_side = 1")
    met = met.join(begins, group, "left").withColumn("_met", F.coalesce("_met", "_carried"))
    near = F.col("_met").isNotNull() & known
    if tolerance is not None:
        near = near & (F.col("_asked") - F.col("_met._at") <= tolerance)
    return met.select(*(F.col("_row")[c].alias(c) for c in left.columns), *(F.when(near, F.col(f"_met._t{i}")).alias(c) for i, c in enumerate(take)))


def covering(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, take: list[str], width: float) -> DataFrame:
    """points with the columns `take` of the interval [start, end) of their group that holds them; intervals of a group do not overlap."""
    held = F.struct(F.col(end).alias("_end"), *take)
    joined = as_of(points, intervals.where(F.col(start) < F.col(end)).select(*by, F.col(start).alias(at), held.alias("_held")), by, at, ["_held"], width)
    inside = F.col(at) < F.col("_held._end")
    return joined.select(*points.columns, *(F.when(inside, F.col("_held")[c]).alias(c) for c in take))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows of a group whose intervals [start, end) share a position; columns of both sides must have names of their own.

    An equi-join on the stretches an interval touches; a pair that shares
    several counts in the first. Empty intervals and null ends meet nothing.
    """
    (a, b), (c, d) = left_span, right_span

    def touched(df, start, end):
        kept = df.where(F.col(start) < F.col(end))
        first, last = _stretch(start, width), F.greatest(F.ceil(F.col(end) / F.lit(width)) - 1, _stretch(start, width))
        return kept.withColumn("_stretch", F.explode(F.sequence(first, last)))

    pairs = touched(left, a, b).join(touched(right, c, d), [*by, "_stretch"])
    shared = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (_stretch(F.greatest(a, c), width) == F.col("_stretch"))
    return pairs.where(shared).drop("_stretch")


def greedy_disjoint(rows: DataFrame, by: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """The rows taken one by one in the given order, each if its interval shares nothing with those taken before in its group.

    A fold over a group's rows as one sorted array: for groups of the size of
    a document's facts. Ties of the order fall to start, end and the others.
    """
    names = [*dict.fromkeys([*order, start, end, *(c for c in rows.columns if c not in by)])]
    one = F.struct(*names)
    kind = "struct<" + ",".join(f"`{c}`:{rows.schema[c].dataType.simpleString()}" for c in names) + ">"
    none = F.array().cast(f"array<{kind}>")
    apart = lambda kept, x: ~F.exists(kept, lambda k: (k[start] < x[end]) & (x[start] < k[end]))
    folded = F.aggregate(F.array_sort(F.collect_list(one)), none, lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return rows.groupBy(*by).agg(folded.alias("_kept")).select(*by, F.inline("_kept")).select(*rows.columns)
