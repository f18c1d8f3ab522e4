"""Embedding near-duplicates by sorted projection passes.

Each pass hashes a vector by the signs of random projections and sorts vectors
of one label by the concatenated signs; the order is cut into windows that
overlap by half, and the vectors of a window are compared, so any two vectors
at most half a window apart in some pass meet. Pairs whose cosine reaches the
threshold are joined up across passes. Only ids and keys are sorted; a vector
then moves to its stretch of eight half windows, and once more where it is in
the half window before the next stretch.

A label's vectors are centred before they are projected, else what they have in
common decides most signs and few tell them apart. The centre is the mean of
about SAMPLE unit vectors of the label; a label that fits half a window needs
none. Centres are a table that is joined to the vectors.

Inside the classes found, every two vectors are compared, in blocks, so each
vector's links within its class are counted in full however large the class.
A link between two classes that no pass joined is not found. Two vectors at the
threshold keep each leading sign with a chance of 1 - angle / pi (0.94 at a
cosine of 0.98, less where centring widens the angle), and meet where they keep
as many as cut their label down to half a window. The number of passes follows
from that and the labels' sizes and spreads, so that such a lone pair is missed
with a chance of about MISSED however large its label. A label that would need
more than `most_passes` is not hashed at all: its vectors are compared in
blocks, every block with every other, which is exact and costs the square of
its size.

Vectors equal in label and components are compared once and weighted.

Nulls and odd input: a null label, a null or zero vector and one with a null
or non-finite component link with nothing; nor do vectors of different
lengths; repeated rows are copies that link with each other; an empty table
gives an empty result. Vectors with a null vec_id take part like any other.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, ranked
from .components import components

SIGNS = 48
#: Half windows in a stretch; the chance to miss a lone pair that sets the number of passes.
STRETCH, MISSED = 8, 1e-3
#: Vectors sampled for a label's centre, and the steps in which spreads are told apart.
SAMPLE, STEPS = 1000, 200


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def keys_of(vectors: np.ndarray, number: int, centres: np.ndarray | float = 0.0) -> np.ndarray:
    """The signs of a pass's random projections of the centred unit vectors as one number, the first sign leading."""
    planes = np.random.default_rng([number, vectors.shape[1]]).standard_normal((vectors.shape[1], SIGNS))
    signs = ((_unit(vectors) - centres) @ planes > 0).astype(np.int64)
    return signs @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))


def passes_for(n: int, half: int, threshold: float, spread: float = 1.0) -> float:
    """Passes after which a lone pair at the threshold, among n vectors of a label, is missed with a chance of MISSED.

    spread: the mean square distance of the label's unit vectors from its centre.
    """
    depth = max(0, math.ceil(math.log2(n / half)))
    kept = 1 - math.acos(max(-1.0, 1 - (1 - threshold) / max(spread, 1e-9))) / math.pi
    meet = kept**depth
    return 1 if meet >= 1 else math.inf if meet < 1e-9 else math.ceil(math.log(MISSED) / math.log1p(-meet))


def _units(batches):
    import pyarrow as pa

    for batch in batches:
        lists = [None if x is None else _unit(np.array([x]))[0] for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lists, pa.list_(pa.float64()))], names=["label", "size", "unit"])


def _large_labels(distinct: DataFrame, half: int) -> DataFrame:
    """(label, size, rows, depth, step, centre) of the labels that do not fit half a window.

    depth: the signs that cut the label down to half a window; step: in which
    of STEPS the mean square distance of its unit vectors from the centre lies.
    """
    key = ["label", "size"]
    sizes = cut(distinct.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > half))
    kind = distinct.schema["label"].dataType.simpleString()
    picked = distinct.join(sizes, key).where(F.pmod(F.xxhash64("node"), F.col("rows")) < SAMPLE).select(*key, "embedding")
    units = picked.mapInArrow(_units, f"label {kind}, size int, unit array<double>")
    means = units.select(*key, F.posexplode("unit").alias("at", "x")).groupBy(*key, "at").agg(F.avg("x").alias("x"))
    # as many numbers as a vector has
    centres = means.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("c"), F.sum(F.col("x") * F.col("x")).alias("square"))
    depth = F.ceil(F.log2(F.col("rows") / half)).cast("int").alias("depth")
    step = F.floor(F.greatest(1 - F.coalesce("square", F.lit(0.0)), F.lit(0.0)) * STEPS).cast("int").alias("step")
    return cut(sizes.join(centres, key, "left").select(*key, "rows", depth, step, F.col("c.x").alias("centre")))


def _hasher(passes: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = np.asarray(batch.column(2))
            lists, centres = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for number in range(passes):
                keys = np.zeros(len(sizes), dtype=np.int64)
                for d in np.unique(sizes):
                    rows = np.flatnonzero(sizes == d)
                    origin = np.zeros(d)
                    around = np.array([origin if centres[i] is None else centres[i] for i in rows])
                    keys[rows] = keys_of(np.array([lists[i] for i in rows]), number, around)
                at = pa.array(np.full(len(sizes), number, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([at, *batch.columns[:3], pa.array(keys)], names=["pass", "node", "label", "size", "order_key"])

    return run


def forest(close: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric adjacency matrix."""
    left = np.ones(len(close), dtype=bool)
    out = []
    for root in range(len(close)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            one = front.pop()
            near = np.flatnonzero(close[one] & left)
            left[near] = False
            out += [(one, int(i)) for i in near]
            front += near.tolist()
    return out


def _grouped(batches, n_keys: int):
    """Arrow batches sorted by their first columns, as pandas frames of one group each."""
    import pandas as pd

    kept, kept_key = [], None
    for batch in batches:
        frame = batch.to_pandas()
        names = list(frame.columns[:n_keys])
        for key, part in frame.groupby(names, sort=False, dropna=False):
            if key == kept_key:
                kept.append(part)
                continue
            if kept:
                yield pd.concat(kept) if len(kept) > 1 else kept[0]
            kept, kept_key = [part], key
    if kept:
        yield pd.concat(kept) if len(kept) > 1 else kept[0]


def _window_links(threshold: float, half: int):
    """Links inside windows of two half windows, each starting half a window after the one before, of every stretch."""

    def run(batches):
        import pyarrow as pa

        for frame in _grouped(batches, 4):
            unit = _unit(np.stack(frame["embedding"].to_numpy()))
            node = frame["node"].to_numpy()
            for at in range(0, max(1, len(unit) - half), half):
                part = unit[at : at + 2 * half]
                pairs = forest(part @ part.T >= threshold)
                u = [int(node[at + a]) for a, _ in pairs]
                v = [int(node[at + b]) for _, b in pairs]
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _block_links(threshold: float):
    """Links inside pairs of blocks of a label."""

    def run(batches):
        import pyarrow as pa

        for frame in _grouped(batches, 4):
            unit = _unit(np.stack(frame["embedding"].to_numpy()))
            node = frame["node"].to_numpy()
            pairs = forest(unit @ unit.T >= threshold)
            yield pa.RecordBatch.from_arrays([pa.array([int(node[a]) for a, _ in pairs], pa.int64()), pa.array([int(node[b]) for _, b in pairs], pa.int64())], names=["u", "v"])

    return run


def _in_block_pairs(rows: DataFrame, count: Column, block: int) -> DataFrame:
    """rows, each once for every pair (i, j) of blocks that its own block is in; a group of `count` rows has blocks of about `block`."""
    rows = rows.withColumn("blocks", F.ceil(count / F.lit(block)).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))
    return rows.withColumn("_p", F.explode(pairs)).select(*rows.columns, "_p.i", "_p.j")


def _class_counts(threshold: float):
    def run(batches):
        import pyarrow as pa

        for frame in _grouped(batches, 3):
            unit = _unit(np.stack(frame["embedding"].to_numpy()))
            close = unit @ unit.T >= threshold
            mine, n = frame["mine"].to_numpy(), frame["n"].to_numpy()
            np.fill_diagonal(close, False)
            if frame["i"].iloc[0] != frame["j"].iloc[0]:
                close &= mine[:, None] != mine[None, :]
            counts = close @ n.astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(frame["node"].to_numpy(), pa.int64()), pa.array(counts.astype(np.int64), pa.int64())], names=["node", "near"])

    return run


def linked_vectors(vectors: DataFrame, threshold: float = 0.98, passes: int = 8, window: int = 2048, block: int = 1024, most_passes: int = 24) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    whole = F.size("embedding") > 0
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole & finite & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(usable, F.lit(False)).alias("usable"))
    distinct = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("embedding")))
    kind = distinct.schema["label"].dataType.simpleString()
    half = window // 2
    key = ["label", "size"]
    large = _large_labels(distinct, half)
    # at most as many rows as there are depths times steps
    kinds = [(r["depth"], r["step"], passes_for(r["rows"], half, threshold, r["step"] / STEPS)) for r in large.groupBy("depth", "step").agg(F.max("rows").alias("rows")).collect()]
    beyond = [F.lit(f"{d}:{s}") for d, s, need in kinds if need > most_passes]
    passes = max([passes, *(need for *_, need in kinds if need <= most_passes)])
    whole = F.concat_ws(":", "depth", "step").isin(*beyond) if beyond else F.lit(False)
    with_centre = distinct.select("node", *key, "embedding").join(large.select(*key, "rows", "centre", whole.alias("whole")), key, "left")
    hashed = with_centre.where(~F.coalesce("whole", F.lit(False))).select("node", *key, "embedding", "centre")
    keyed = hashed.mapInArrow(_hasher(passes), f"pass int, node long, label {kind}, size int, order_key long")
    placed = ranked(keyed, [F.col(c) for c in ("pass", "label", "size", "order_key", "node")], "place")
    order = ("window", "pass", "label", "size")
    stretch = STRETCH * half
    # a row of the last half window of a stretch leads the next one too
    meets = F.array_distinct(F.array(F.floor(F.col("place") / stretch), F.floor((F.col("place") + half) / stretch)))
    placed = placed.withColumn("window", F.explode(meets)).select(*order, "place", "node")
    meet = placed.join(distinct.select("node", "embedding"), "node").select(*order, "place", "node", "embedding")
    meet = meet.repartition(*order).sortWithinPartitions(*order, "place")
    found = meet.mapInArrow(_window_links(threshold, half), "u long, v long")
    if beyond:
        blocked = _in_block_pairs(with_centre.where("whole").select("node", *key, "embedding", "rows"), F.col("rows"), half)
        blocked = blocked.select(*key, "i", "j", "node", "embedding").repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")
        found = found.unionByName(blocked.mapInArrow(_block_links(threshold), "u long, v long"))
    roots = cut(components(found))
    classes = distinct.select("node", "least", "n").join(roots, "node")
    # a table of its own, not an aggregate in the joins' stages: so Spark can split the rows of a large class
    names = cut(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    classes = distinct.select("node", "embedding", "n").join(roots, "node").join(names, "root")
    dealt = _in_block_pairs(classes, F.col("members"), block).select("root", "i", "j", "node", "mine", "n", "embedding")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    near = dealt.mapInArrow(_class_counts(threshold), "node long, near long").groupBy("node").agg(F.sum("near").alias("near"))
    named = roots.join(names, "root").select("node", "component_id")
    results = distinct.join(near, "node", "left").join(named, "node", "left").select(
        "label", "embedding", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    linked = rows.where("usable").join(results, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
