"""The document-clustered bootstrap of any statistic.

A statistic is one of three kinds, by what a replicate must know of the rows:

* `Sums`: sums of terms, and a value of those sums (means, variances,
  correlations, slopes).
* `Ranks`: the values at some places of the resampled rows in order, and the
  sums below them (quantiles, trimmed means, tail means). Exact, without
  ordering any replicate's rows: counts in bins tell in which bin each
  replicate's place lies; bins that hold places are cut finer until the rows
  inside them, each for the replicates that look there only, are few enough
  to be counted value by value.
* `States`: a user's own arrays with a merge, for what is neither.

All kinds take documents by the same draws as the other bootstraps, so
intervals of different statistics with one seed are paired. A replicate for
which a statistic does not exist is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .inference import AT_ONCE, FINAL_REPLICATES, WHOLE, hashed_rows, interval, replicate_sums, times_taken
from .ranks import cut

#: Bins of one cut, and the number of (row, replicate) pairs that may be counted value by value.
BINS, RESOLVED = 16, 50_000_000


@dataclass(frozen=True)
class Sums:
    """terms: summed over a replicate's rows; value: of the sums' columns and `times`, the number of rows."""

    terms: dict[str, Column]
    value: Column


@dataclass(frozen=True)
class Ranks:
    """of: the value of a row; places: 0-based places for a number of rows; value: of that number, the values there and the sums of the rows before them."""

    of: Column
    places: Callable[[Column], list[Column]]
    value: Callable[[Column, list[Column], list[Column]], Column]


@dataclass(frozen=True)
class States:
    """columns of a row; zero(replicates) makes a numpy state whose first axis is replicates; add(state, values, times) and merge(a, b) give a new one, value(state) a number for each replicate (nan: none)."""

    columns: list[str]
    zero: Callable
    add: Callable
    merge: Callable
    value: Callable


def quantile(of: Column, p: float) -> Ranks:
    """The quantile between neighbouring places, as percentiles of a list are."""
    place = lambda n: (n - 1) * F.lit(p)
    return Ranks(of, lambda n: [F.floor(place(n)), F.ceil(place(n))], lambda n, at, _: at[0] + (at[1] - at[0]) * (place(n) - F.floor(place(n))))


def trimmed_mean(of: Column, share: float) -> Ranks:
    """The mean of what is left when the share of the rows is taken off at either end."""
    off = lambda n: F.floor(n * F.lit(share))
    return Ranks(of, lambda n: [off(n), n - off(n)], lambda n, _, below: (below[1] - below[0]) / F.nullif(n - 2 * off(n), F.lit(0)))


def upper_tail_mean(of: Column, share: float) -> Ranks:
    """The mean of the largest share of the rows, one row at least."""
    rest = lambda n: n - F.greatest(F.ceil(n * F.lit(share)), F.lit(1))
    return Ranks(of, lambda n: [rest(n), n], lambda n, _, below: (below[1] - below[0]) / (n - rest(n)))


def mean_of(of: Column) -> Sums:
    return Sums({"total": of}, F.col("total") / F.nullif("times", F.lit(0.0)))


def correlation(x: Column, y: Column) -> Sums:
    s, n = F.col, F.col("n_both")
    spread = lambda a: n * s(f"{a}{a}") - s(a) * s(a)
    both = (x.isNotNull() & y.isNotNull()).cast("double")
    terms = {"n_both": both, "x": x * both, "y": y * both, "xx": x * x * both, "yy": y * y * both, "xy": x * y * both}
    scale = F.sqrt(spread("x") * spread("y"))
    return Sums(terms, F.when((spread("x") > 0) & (spread("y") > 0), (n * s("xy") - s("x") * s("y")) / scale))


def replicate_values(rows: DataFrame, statistic: Sums | Ranks | States, replicates: int, seed: int, key: str = "document_id") -> DataFrame:
    """(replicate, v): the statistic of each replicate, and of the rows themselves as replicate WHOLE."""
    if isinstance(statistic, Sums):
        names = list(statistic.terms)
        terms = rows.select(F.col(key).alias("document_id"), *(c.cast("double").alias(name) for name, c in statistic.terms.items()))
        # a document's rows are taken together: draws are made for documents, not for rows
        sums = terms.groupBy("document_id").agg(*(F.sum(c).alias(c) for c in names), F.count("*").cast("double").alias("_rows"))
        whole = replicate_sums(sums, [*names, "_rows"], replicates, seed, whole=True)
        return whole.drop("times").withColumnRenamed("_rows", "times").select("replicate", statistic.value.alias("v"))
    if isinstance(statistic, States):
        return _merged(rows, statistic, replicates, seed, key)
    return _ranked(rows, statistic, replicates, seed, key)


def bootstrap(rows: DataFrame, statistic: Sums | Ranks | States, replicates: int = FINAL_REPLICATES, seed: int = 0, alpha: float = 0.05, key: str = "document_id") -> DataFrame:
    """(point, n_documents, lower, upper, n_replicates) of a statistic of rows, resampled by document."""
    documents = rows.select(key).distinct().count()
    if not documents:
        raise ValueError("no documents to resample")
    values = cut(replicate_values(rows, statistic, replicates, seed, key))
    point = values.where(F.col("replicate") == WHOLE).agg(F.max("v").alias("point"), F.lit(documents).cast("long").alias("n_documents"))
    ends = interval(values.where(F.col("replicate") != WHOLE).where(~F.isnan("v")), alpha)
    return point.crossJoin(ends)  # one row each


def paired_statistic(first: DataFrame, second: DataFrame, statistic: Sums | Ranks | States, replicates: int = FINAL_REPLICATES, seed: int = 0, alpha: float = 0.05, key: str = "document_id") -> DataFrame:
    """The same of the statistic's difference between two arms under one draw; both must cover the same documents."""
    keys = [d.select(key).distinct() for d in (first, second)]
    n, odd = keys[0].withColumn("_a", F.lit(1)).join(keys[1].withColumn("_b", F.lit(1)), key, "full_outer").agg(F.count("*"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull())).first()
    if odd or not n:
        raise ValueError(f"{odd} of {n} documents are in one arm only")
    one, two = (replicate_values(d, statistic, replicates, seed, key) for d in (first, second))
    values = cut(one.withColumnRenamed("v", "_v").join(two, "replicate").select("replicate", (F.col("_v") - F.col("v")).alias("v")))
    point = values.where(F.col("replicate") == WHOLE).agg(F.max("v").alias("point"), F.lit(n).cast("long").alias("n_documents"))
    return point.crossJoin(interval(values.where(F.col("replicate") != WHOLE).where(~F.isnan("v")), alpha))  # one row each


# Statistics of places.


def _edges(rows: DataFrame) -> list[float]:
    """Inner edges of bins of like numbers of rows; the bins bear on the cost only, never on a result."""
    return sorted(set(rows.approxQuantile("v", [i / BINS for i in range(1, BINS)], 0.01)))


def _bin_of(bins: list[tuple]) -> Column:
    """The number of the bin [low, high) that holds v; null outside all; open ends are None."""
    found = F.lit(None).cast("int")
    for i, (low, high) in enumerate(bins):
        inside = F.lit(True)
        inside = inside if low is None else inside & (F.col("v") >= low)
        found = F.when(inside if high is None else inside & (F.col("v") < high), i).otherwise(found)
    return found


def _split(bins: list[tuple], edges: list[float]) -> list[tuple]:
    """Each bin cut at the edges inside it."""
    out = []
    for low, high in bins:
        inner = [e for e in edges if (low is None or e > low) and (high is None or e < high)]
        ends = [low, *inner, high]
        out += list(zip(ends, ends[1:]))
    return out


def _ranked(rows: DataFrame, statistic: Ranks, replicates: int, seed: int, key: str) -> DataFrame:
    values = rows.select(F.col(key).alias("document_id"), statistic.of.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    counted = cut(values.groupBy("document_id", "v").agg(F.count("*").cast("double").alias("c")))
    bins = _split([(None, None)], _edges(counted))
    parent, places = None, None
    while True:
        placed = counted.withColumn("bin", _bin_of(bins)).where("bin IS NOT NULL")
        terms = {f"{x}{i}": F.when(F.col("bin") == i, F.col("c") * (F.col("v") if x == "s" else F.lit(1.0))) for i in range(len(bins)) for x in "ns"}
        sums = replicate_sums(placed.select("document_id", *(c.alias(k) for k, c in terms.items())), list(terms), replicates, seed, whole=True)
        held = sums.select("replicate", F.explode(F.array(*(F.struct(F.lit(i).alias("bin"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s")) for i in range(len(bins))))).alias("_b")).select("replicate", "_b.*")
        if places is None:
            totals = cut(held.groupBy("replicate").agg(F.sum("n").cast("long").alias("n"), F.sum("s").alias("s")).where("n > 0"))
            ranks = statistic.places(F.col("n"))
            asked = totals.select("replicate", F.col("n").alias("total"), F.posexplode(F.array(*(r.cast("long") for r in ranks))).alias("j", "rank"))
            places = asked.where("rank < total").select("replicate", "j", "rank", F.lit(0).alias("bin"), F.lit(0.0).alias("n0"), F.lit(0.0).alias("s0"))
            parent = {i: 0 for i in range(len(bins))}
        inner = held.withColumn("parent", F.element_at(F.array(*(F.lit(parent[i]) for i in range(len(bins)))), F.col("bin") + 1))
        along = W.partitionBy("replicate", "j").orderBy("_new")
        met = places.join(inner.select("replicate", F.col("parent").alias("bin"), F.col("bin").alias("_new"), "n", "s"), ["replicate", "bin"])
        met = met.withColumns({"n1": F.col("n0") + F.sum("n").over(along), "s1": F.col("s0") + F.sum("s").over(along)})
        places = cut(met.where((F.col("rank") < F.col("n1")) & (F.col("rank") >= F.col("n1") - F.col("n"))).select("replicate", "j", "rank", F.col("_new").alias("bin"), (F.col("n1") - F.col("n")).alias("n0"), (F.col("s1") - F.col("s")).alias("s0")))
        looked = {r["bin"]: r["n"] for r in places.groupBy("bin").agg(F.count_distinct("replicate").alias("n")).collect()}
        live = counted.withColumn("bin", _bin_of(bins)).where(F.col("bin").isin(list(looked) or [-1]))
        sizes = {r["bin"]: r["n"] for r in live.groupBy("bin").agg(F.count_distinct("v").alias("n")).collect()}
        if sum(looked[b] * n for b, n in sizes.items()) <= RESOLVED or max(sizes.values(), default=0) <= 1:
            break
        finer, parent = [], {}
        for b in sorted(looked):
            cuts = _split([bins[b]], _edges(live.where(F.col("bin") == b)) if sizes[b] > 1 else [])
            parent |= {len(finer) + i: b for i in range(len(cuts))}
            finer += cuts
        bins = finer
    found = _resolved(live, places, replicates, seed)
    n_places = len(statistic.places(F.lit(1)))
    by_place = found.groupBy("replicate").agg(*(F.max(F.when(F.col("j") == j, F.col(x))).alias(f"{x}{j}") for j in range(n_places) for x in ("v", "below")))
    joined = totals.join(by_place, "replicate", "left")
    below = [F.when(r >= F.col("n"), F.col("s")).otherwise(F.col(f"below{j}")) for j, r in enumerate(statistic.places(F.col("n")))]
    return joined.select("replicate", statistic.value(F.col("n"), [F.col(f"v{j}") for j in range(n_places)], below).alias("v"))


def _resolved(live: DataFrame, places: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, j, v, below): the value at each place and the sum of the rows before it, from the rows of the bins that hold places.

    Which replicates look into which bin travels with the tasks: at most
    replicates times places numbers.
    """
    look: dict[int, set] = {}
    for r in places.select("replicate", "bin").distinct().collect():
        look.setdefault(r["bin"], set()).add(r["replicate"])
    looking = {b: sorted(rs) for b, rs in look.items()}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            high, low = (batch.column(k).to_numpy() for k in (0, 1))
            c, v, bins = (batch.column(k).to_numpy() for k in (2, 3, 4))
            for b in np.unique(bins).tolist():
                mine = np.flatnonzero(bins == b)
                mine = mine[np.argsort(v[mine], kind="stable")]
                first = np.flatnonzero(np.diff(v[mine], prepend=np.nan) != 0)
                which = looking.get(b, [])
                for at in range(0, len(which), AT_ONCE):
                    some = which[at : at + AT_ONCE]
                    taken = np.add.reduceat(times_taken(high[mine], low[mine], some, seed) * c[mine][:, None], first, axis=0)
                    i, k = np.nonzero(taken)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(some)[k]), pa.array(np.full(len(i), b, dtype=np.int32)), pa.array(v[mine][first][i]), pa.array(taken[i, k])], names=["replicate", "bin", "v", "n"]
                    )

    hashed = hashed_rows(live, seed, ["c", "v", "bin"])
    parts = hashed.mapInArrow(run, "replicate long, bin int, v double, n double")
    counts = parts.groupBy("replicate", "bin", "v").agg(F.sum("n").alias("n"))
    along = W.partitionBy("replicate", "bin").orderBy("v")
    counts = counts.withColumns({"n1": F.sum("n").over(along), "s1": F.sum(F.col("n") * F.col("v")).over(along)})
    met = counts.join(places, ["replicate", "bin"])
    before, start = F.col("n0") + F.col("n1") - F.col("n"), F.col("s0") + F.col("s1") - F.col("n") * F.col("v")
    met = met.where((F.col("rank") >= before) & (F.col("rank") < before + F.col("n")))
    return met.select("replicate", "j", "v", (start + (F.col("rank") - before) * F.col("v")).alias("below"))


# A user's own states.


def _merged(rows: DataFrame, statistic: States, replicates: int, seed: int, key: str) -> DataFrame:
    starts = [-1, *range(0, replicates, AT_ONCE)]
    blocks = [[WHOLE] if at < 0 else list(range(at, min(replicates, at + AT_ONCE))) for at in starts]

    def packed(state) -> bytes:
        import io

        import numpy as np

        out = io.BytesIO()
        np.save(out, state, allow_pickle=False)
        return out.getvalue()

    def unpacked(data: bytes):
        import io

        import numpy as np

        return np.load(io.BytesIO(data), allow_pickle=False)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        states = [statistic.zero(len(b)) for b in blocks]
        for batch in batches:
            high, low = (batch.column(k).to_numpy() for k in (0, 1))
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]])
            states = [statistic.add(s, values, times_taken(high, low, b, seed)) for s, b in zip(states, blocks)]
        for i, s in enumerate(states):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed(s)], pa.binary())], names=["block", "state"])

    def together(table):
        import pyarrow as pa

        state = None
        for data in table.column("state"):
            one = unpacked(data.as_py())
            state = one if state is None else statistic.merge(state, one)
        return pa.table({"block": table.column("block").slice(0, 1), "state": pa.array([packed(state)], pa.binary())})

    def finish(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(blocks[i], pa.int64()), pa.array(np.asarray(statistic.value(unpacked(data)), dtype=np.float64))], names=["replicate", "v"])

    parts = hashed_rows(rows.withColumnRenamed(key, "document_id"), seed, statistic.columns).mapInArrow(run, "block int, state binary")
    some = parts.withColumn("_part", F.spark_partition_id() % 32).groupBy("block", "_part").applyInArrow(together, "block int, state binary")
    whole = some.groupBy("block").applyInArrow(together, "block int, state binary")
    return whole.mapInArrow(finish, "replicate long, v double").where("NOT isnan(v)")
