"""Sharding along a Hilbert curve over document metadata.

Language, source and size are each quantised to five bits, in their own order:
languages and sources by the place of the value among all values met, sizes by
quantiles of the rows. Rows are sorted by their index on the Hilbert curve
through that grid, then by the crc32 of the text and doc_id, and the order is
cut into runs. Neighbours on the curve differ little in any dimension, so a
reader can skip shards by the minima and maxima of any of the three; only a
value with most of the rows opens most shards.

The values met are ranked as a table, which is broadcast only where it has at
most SMALL_VALUES rows and SMALL_BYTES bytes, else joined by a shuffle. The
driver holds 31 size limits.

The law is `rows`: shard sizes differ by one row at most. Equal texts of like
metadata stand together; a group larger than a shard is cut like any other
run, because the law binds first.

Nulls and odd input: a null text has size 8 and crc32 0; a null language or
source is a value of its own; ties fall to doc_id, and rows alike in all of it
are interchangeable; an empty table gives an empty result; fewer rows than
shards leave shards empty; columns of other names are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, ranked

BITS = 5
CLASSES = 1 << BITS
#: A table of values larger than either is not broadcast.
SMALL_VALUES, SMALL_BYTES = 100_000, 10 << 20


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with `bits`-bit coordinates.

    Walks from the highest bit down. `flip` holds the coordinates' bits to be
    inverted and `turn` the rotation of the axes inside the current subcube.
    """
    n = len(axes)
    mask = (1 << n) - 1
    rows = len(axes[0]) if n else 0
    out = np.zeros(rows, dtype=np.int64)
    flip = np.zeros(rows, dtype=np.int64)
    turn = np.zeros(rows, dtype=np.int64)
    rotate_left = lambda x, k: ((x << k) | (x >> (n - k))) & mask
    for bit in range(bits - 1, -1, -1):
        corner = np.zeros(rows, dtype=np.int64)
        for k, axis in enumerate(axes):
            corner |= ((axis.astype(np.int64) >> bit) & 1) << k
        place = corner ^ flip
        place = ((place >> turn) | (place << (n - turn))) & mask
        step = place.copy()  # inverse of the Gray code
        shift = 1
        while shift < n:
            step ^= step >> shift
            shift *= 2
        out = (out << n) | step
        before = np.where(step == 0, 0, (step - 1) & ~1)
        entry = before ^ (before >> 1)
        flip = flip ^ rotate_left(entry, turn)
        odd = np.where(step == 0, 0, np.where(step & 1, step, step - 1))
        ones = np.zeros(rows, dtype=np.int64)
        run = odd.copy()
        for _ in range(n):  # trailing ones
            ones += (run & 1) == 1
            run = np.where(run & 1, run >> 1, 0)
        turn = (turn + ones + 1) % n
    return out


def _with_class(rows: DataFrame, met: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the class of a column's value: its place among the values met, scaled to the grid; nulls come first."""
    values = met.select(F.col(column).alias("_value")).distinct()
    n, held = values.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("_value").cast("string"))), F.lit(0))).first()
    # few values are numbered in one task; more are dealt out by range
    few = n <= SMALL_VALUES
    placed = values.withColumn("_place", F.row_number().over(Window.orderBy("_value")) - 1) if few else ranked(values, [F.col("_value")], "_place")
    values = placed.select("_value", F.expr(f"cast(_place * {CLASSES} div {max(1, n)} as long)").alias(name))
    values = F.broadcast(values) if few and held <= SMALL_BYTES else values
    return rows.join(values, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def _curve(batches):
    import pyarrow as pa

    for batch in batches:
        axes = [batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hilbert_index(axes, BITS))], names=["doc_id", "size", "text_crc32", "curve"])


def hilbert_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("long") + 8
    rows = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(text).alias("text_crc32"))
    limits = rows.approxQuantile("size", [i / CLASSES for i in range(1, CLASSES)], 0.001)
    size_class = sum((F.when(F.col("size") > limit, 1).otherwise(0) for limit in limits), F.lit(0)).cast("long")
    met = cut(rows.select("lang", "source").distinct())
    for column, name in (("lang", "a"), ("source", "b")):
        rows = _with_class(rows, met, column, name)
    classes = rows.select("doc_id", "size", "text_crc32", "a", "b", size_class.alias("c"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = classes.mapInArrow(_curve, f"doc_id {kind}, size long, text_crc32 long, curve long")
    order = [F.col(c) for c in ("curve", "text_crc32", "doc_id", "size")]
    placed = ranked(rows, order, "_rank")
    total = placed.count()
    shard = F.expr(f"cast(_rank * {shards} div {max(1, total)} as int)")
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
