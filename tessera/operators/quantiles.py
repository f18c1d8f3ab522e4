"""Exact quantiles by rank selection: ranges and counts, no table's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranks import cut


def quantiles(rows: DataFrame, column: Column | str, probs: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, one column for each name of probs, n): the quantiles of a column in each group, interpolated between neighbours.

    Equal values are counted first, in the tasks that read them, and dealt out
    by range of group and value. Each range's count tells which ranges hold
    the places asked for, and only those are put in order. Nulls do not count;
    a group of nulls only has no row, except that without groups the one row
    is of nulls.
    """
    by = by or []
    value = F.col(column) if isinstance(column, str) else column
    keyed = rows.select(F.struct(*by).alias("_by") if by else F.struct(F.lit(0)).alias("_by"), value.cast("double").alias("_v")).where("_v IS NOT NULL")
    counted = keyed.groupBy("_by", "_v").agg(F.count("*").alias("_n"))
    dealt = cut(counted.repartitionByRange("_by", "_v").withColumn("_task", F.spark_partition_id()))
    held = dealt.groupBy("_by", "_task").agg(F.sum("_n").alias("_held"))
    group = W.partitionBy("_by")
    held = held.withColumns({"_before": F.sum("_held").over(group.orderBy("_task")) - F.col("_held"), "_total": F.sum("_held").over(group)})
    place = {name: (F.col("_total") - 1) * F.lit(p) for name, p in probs.items()}
    part = {name: h - F.floor(h) for name, h in place.items()}
    ends = [F.struct(F.lit(name).alias("name"), (F.floor(h) + k).alias("rank"), (part[name] if k else 1 - part[name]).alias("share")) for name, h in place.items() for k in (0, 1)]
    asked = held.select("_by", "_task", "_before", "_held", "_total", F.explode(F.array(*ends)).alias("_e")).select("_by", "_task", "_before", "_held", "_total", "_e.*")
    asked = cut(asked.where((F.col("share") > 0) & (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_held"))))
    open_ranges = asked.select("_by", "_task", "_before").distinct()
    ordered = dealt.join(open_ranges, ["_by", "_task"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(W.partitionBy("_by", "_task").orderBy("_v")))
    found = ordered.select("_by", "_task", "_v", "_n", "_upto").join(asked.drop("_before"), ["_by", "_task"]).where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_n")))
    named = [F.sum(F.when(F.col("name") == name, F.col("_v") * F.col("share"))).alias(name) for name in probs]
    if not by:
        return found.agg(*named, F.coalesce(F.max("_total"), F.lit(0)).alias("n"))
    return found.groupBy("_by").agg(*named, F.max("_total").alias("n")).select("_by.*", *probs, "n")
