"""Document-clustered bootstrap, verdicts and agreement statistics.

Every statistic bootstrapped here is a ratio of sums over documents, so a replicate
needs only each document's sums and how often it draws the document. Those
draws are independent Poisson numbers of mean one, to which the numbers of
times that n draws of n documents take each tend. Two hashes of the document
(60 bits together) times two of the replicate give each, in any engine, on any
partitioning. So all replicates come from one pass over the documents, as a matrix product in each
task, without a join, a place or a count of them, and what is shuffled are sums
for each replicate.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions.draws import draw

from .quantiles import quantiles

#: Replicates of a final and of a smoke run, and the normal quantile of a 95 % interval.
FINAL_REPLICATES, SMOKE_REPLICATES = 10_000, 200
Z95 = 1.959963984540054


#: A document's two hashes of 30 bits are multiplied by a replicate's two and added, modulo this prime; the first 15 bits are the draw.
PRIME, HALF, DRAW_BITS = 2**31 - 1, 30, 15
#: A draw takes a document as often as it reaches one of these: the cumulative Poisson probabilities of mean one.
TAKEN = tuple(round(2**DRAW_BITS * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(7))
#: Replicates whose draws are held at once, for each document of a batch.
AT_ONCE = 256
#: Rows whose draws are worked out at once: they stay in a processor's cache.
ROWS_AT_ONCE = 128
#: The number of the replicate that takes every document once.
WHOLE = -1


def hashed_rows(rows: DataFrame, seed: int, columns: list, key: str = "document_id") -> DataFrame:
    """(the document's two hashes, columns), dealt out by document."""
    h = draw(seed, F.col(key))
    hashed = rows.select(F.shiftright(h, HALF).alias("_high"), h.bitwiseAND(F.lit((1 << HALF) - 1)).alias("_low"), *columns)
    # few rows make much work: a fixed number of tasks is not merged for its few bytes
    return hashed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_high", "_low")


def times_taken(high, low, replicates: list[int], seed: int):
    """How often each replicate takes each document: rows x replicates."""
    import numpy as np

    reached = np.searchsorted(np.array(TAKEN), np.arange(2**DRAW_BITS), side="right").astype(np.float64)
    factors = np.array([replicate_hashes(seed, r) for r in replicates], dtype=np.uint64).reshape(-1, 2)
    high, low, prime, bits = high.astype(np.uint64), low.astype(np.uint64), np.uint64(PRIME), np.uint64(31)
    times = np.empty((len(high), len(factors)))
    for at in range(0, len(high), ROWS_AT_ONCE):
        part = slice(at, at + ROWS_AT_ONCE)
        mixed = high[part, None] * factors[None, :, 0]
        mixed += low[part, None] * factors[None, :, 1]  # below 2^62
        for _ in range(2):  # 2^31 is one more than the prime: folding keeps the remainder, and twice leaves the prime at most
            over = mixed >> bits
            mixed &= prime
            mixed += over
        mixed[mixed == prime] = 0
        mixed >>= np.uint64(31 - DRAW_BITS)
        np.take(reached, mixed.astype(np.intp), out=times[part], mode="clip")
    times[:, [i for i, r in enumerate(replicates) if r == WHOLE]] = 1.0
    return times


def replicate_sums(stats: DataFrame, columns: list[str], replicates: int, seed: int, by: list[str] | None = None, key: str = "document_id", whole: bool = False) -> DataFrame:
    """(by, replicate, columns, times): each replicate's sums of the columns, and of the rows taken.

    Rows of one document in different groups are taken equally often. A task
    gives one row for each of its groups and replicates. A null adds nothing.
    whole: also the replicate WHOLE, which takes every document once.
    """
    by = by or []
    hashed = hashed_rows(stats, seed, [*(F.col(c) for c in by), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns)], key)
    numbers = [*([WHOLE] if whole else []), *range(replicates)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            high, low = (batch.column(k).to_numpy() for k in (0, 1))
            groups = list(zip(*(c.to_pylist() for c in batch.columns[2 : 2 + len(by)]))) if by else [()] * batch.num_rows
            values = np.column_stack([*(c.to_numpy() for c in batch.columns[2 + len(by) :]), np.ones(len(high))])
            for at in range(0, len(numbers), AT_ONCE):
                times = times_taken(high, low, numbers[at : at + AT_ONCE], seed)
                for group in dict.fromkeys(groups):
                    mine = np.array([g == group for g in groups]) if by else slice(None)
                    total = sums.setdefault(group, np.zeros((len(numbers), values.shape[1])))
                    total[at : at + AT_ONCE] += times[mine].T @ values[mine]
        for group, total in sums.items():
            names = [pa.array([g] * len(numbers)) for g in group]
            yield pa.RecordBatch.from_arrays([*names, pa.array(numbers, pa.int64()), *(pa.array(x) for x in total.T)], names=[*by, "replicate", *columns, "times"])

    kinds = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "replicate long", *(f"{c} double" for c in [*columns, "times"])])
    parts = hashed.mapInArrow(run, schema)
    return parts.groupBy(*by, "replicate").agg(*(F.sum(c).alias(c) for c in [*columns, "times"]))


def replicate_hashes(seed: int, replicate: int) -> tuple[int, int]:
    bits = int(hashlib.sha256(f"{seed}|replicate|{replicate}".encode()).hexdigest()[:15], 16)
    return bits >> HALF, bits & ((1 << HALF) - 1)


def interval(values: DataFrame, alpha: float) -> DataFrame:
    """The percentile interval of the replicates' values v; as many rows as replicates at most."""
    ends = [F.percentile("v", F.lit(p)).alias(name) for p, name in ((alpha / 2, "lower"), (1 - alpha / 2, "upper"))]
    return values.where("v IS NOT NULL").agg(*ends, F.count("*").alias("n_replicates"))


def bootstrap_ratio(stats: DataFrame, numerator: str, denominator: str, replicates: int = FINAL_REPLICATES, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Point and percentile interval of sum(numerator) / sum(denominator) over documents.

    stats: one row for each document. Replicates whose denominator is zero
    are left out. No documents at all is an error.
    """
    stats = stats.select("document_id", F.col(numerator).alias("a"), F.col(denominator).alias("b"))
    ratio = F.col("a") / F.nullif("b", F.lit(0.0))
    if stats.isEmpty():
        raise ValueError("no documents to resample")
    point = stats.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n_documents"))
    values = replicate_sums(stats, ["a", "b"], replicates, seed).select(ratio.alias("v"))
    return point.select(ratio.alias("point"), "n_documents").crossJoin(interval(values, alpha))  # one row each


def paired_bootstrap(first: DataFrame, second: DataFrame, numerator: str, denominator: str, replicates: int = FINAL_REPLICATES, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """The interval of the ratio's difference between two arms under one draw of documents.

    Both arms must cover the same documents.
    """
    arm = lambda d, k: d.select("document_id", F.col(numerator).alias(f"a{k}"), F.col(denominator).alias(f"b{k}"))
    joined = arm(first, 1).join(arm(second, 2), "document_id", "full_outer")
    names = ["a1", "b1", "a2", "b2"]
    gap = F.col("a1") / F.nullif("b1", F.lit(0.0)) - F.col("a2") / F.nullif("b2", F.lit(0.0))
    n, odd = joined.agg(F.count("*"), F.count_if(F.col("b1").isNull() | F.col("b2").isNull())).first()
    if odd or not n:
        raise ValueError(f"{odd} of {n} documents are in one arm only")
    point = joined.agg(*(F.sum(c).alias(c) for c in names)).select(gap.alias("point"), F.lit(n).cast("long").alias("n_documents"))
    values = replicate_sums(joined, names, replicates, seed).select(gap.alias("v"))
    return point.crossJoin(interval(values, alpha))  # one row each


def simultaneous_bootstrap(differences: DataFrame, replicates: int = FINAL_REPLICATES, seed: int = 42, alpha: float = 0.05, least_families: int = 4, least_documents: int = 10) -> DataFrame:
    """Lower bounds that hold for all comparators at once, by the maximum statistic.

    differences: (document_id, comparator, delta_a, delta_c), ours minus
    theirs. Only documents that every comparator has count. The deviation of
    each replicate is its largest over comparators; its (1 - alpha) percentile
    is taken off every point estimate.
    """
    k = differences.select("comparator").distinct().count()
    if not k:
        raise ValueError("no comparators")
    common = differences.groupBy("document_id").agg(F.count_distinct("comparator").alias("_k")).where(F.col("_k") == k).select("document_id")
    n = common.count()
    if n < least_documents:
        raise ValueError(f"{n} documents in common are too few")
    rows = differences.join(common, "document_id").select("document_id", "comparator", "delta_a", "delta_c")
    points = rows.groupBy("comparator").agg(F.avg("delta_a").alias("point_a"), F.avg("delta_c").alias("point_c"))
    sums = replicate_sums(rows, ["delta_a", "delta_c"], replicates, seed, ["comparator"]).where("times > 0")
    worst = sums.join(points, "comparator").groupBy("replicate").agg(*(F.max(F.col(f"point_{x}") - F.col(f"delta_{x}") / F.col("times")).alias(f"worst_{x}") for x in "ac"))
    cut = worst.agg(*(F.percentile(f"worst_{x}", F.lit(1 - alpha)).alias(f"cut_{x}") for x in "ac"))
    out = points.crossJoin(cut).select("comparator", F.lit(n).cast("long").alias("n_documents"), "point_a", (F.col("point_a") - F.col("cut_a")).alias("lower_a"), "point_c", (F.col("point_c") - F.col("cut_c")).alias("lower_c"))
    out = out.withColumns({"directional_win": (F.col("point_a") > 0) & (F.col("point_c") > 0), "simultaneous_win": (F.col("lower_a") > 0) & (F.col("lower_c") > 0)})
    every = F.min(F.col("simultaneous_win").cast("int")).over(W.partitionBy(F.lit(1)))
    return out.withColumn("verdict", F.when(F.lit(k < least_families), "INELIGIBLE").when(every == 1, "PASS").otherwise("NOT_ESTABLISHED"))


def superiority(comparisons: DataFrame, eligible: DataFrame, families: DataFrame, registered: DataFrame, required_wins: int = 3, required_families: int = 3) -> DataFrame:
    """One row: wins, losses, families and whether superiority may be claimed.

    comparisons: (comparator, lower_a, lower_c). eligible, registered:
    (comparator). families: (comparator, family); a comparator without one is
    a family of its own. With exactly the required number of families every
    eligible comparator must be beaten.
    """
    stray = comparisons.join(registered, "comparator", "left_anti")
    if (names := [r[0] for r in stray.select("comparator").distinct().limit(20).collect()]):
        raise ValueError(f"comparators outside the registered suite: {sorted(names)}")
    named = eligible.join(families, "comparator", "left").select("comparator", F.coalesce("family", "comparator").alias("family"))
    won = (F.col("lower_a") > 0) & (F.col("lower_c") > 0)
    judged = named.join(comparisons, "comparator", "left").withColumn("won", F.coalesce(won, F.lit(False))).withColumn("judged", F.col("lower_a").isNotNull())
    out = judged.agg(
        F.count_if("won").alias("n_wins"), F.count_if(F.col("judged") & ~F.col("won")).alias("n_losses"), F.count("*").alias("n_eligible"),
        F.count_distinct("family").alias("n_families"), F.count_distinct(F.when(F.col("won"), F.col("family"))).alias("n_winning_families"),
    )
    needed = F.when(F.col("n_families") == required_families, F.col("n_eligible")).otherwise(required_wins)
    headline = F.col("n_families") >= required_families
    out = out.withColumns({"headline_eligible": headline, "wins_needed": needed.cast("long")})
    return out.withColumn("permitted", F.col("headline_eligible") & (F.col("n_wins") >= F.col("wins_needed")) & (F.col("n_winning_families") >= required_families))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; (0, 1) without trials."""
    p, zz = successes / F.nullif(n, F.lit(0)), z * z
    d = 1 + zz / n
    centre, half = (p + zz / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / d
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))


def cohen_kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Agreement beyond chance; 1 where chance alone agrees in full."""
    by = by or []
    cells = pairs.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).alias("same"))
    left = cells.groupBy(*by, F.col("a").alias("label")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*by, F.col("b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    joined = total.join(chance, by, "left") if by else total.crossJoin(chance)
    observed, expected = F.col("same") / F.col("total"), F.coalesce("chance", F.lit(0)) / (F.col("total") * F.col("total"))
    out = joined.withColumns({"observed": observed, "expected": expected})
    return out.select(*by, F.col("total").alias("n"), "observed", "expected", F.when(F.col("expected") >= 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def confusion(pairs: DataFrame, predicted: str, truth: str, by: list[str] | None = None, least: int = 100, precision_gate: float = 0.98, recall_gate: float = 0.95) -> DataFrame:
    """Confusion counts, precision, recall (1 without a case) and whether the gate is passed."""
    p, t = F.col(predicted).cast("boolean"), F.col(truth).cast("boolean")
    out = pairs.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(t).alias("n_presence"), F.count_if(~t).alias("n_absence"),
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"),
    )
    rate = lambda other: F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col(other), F.lit(0)), F.lit(1.0))
    out = out.withColumns({"precision": rate("fp"), "recall": rate("fn")})
    return out.withColumn("passed", (F.col("precision") >= precision_gate) & (F.col("recall") >= recall_gate) & (F.col("n_presence") >= least) & (F.col("n_absence") >= least))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests (name, p) with Holm-adjusted p-values and rejections."""
    order, all_rows = W.orderBy("p", "name"), W.partitionBy(F.lit(1))
    raw = tests.withColumn("_k", F.row_number().over(order)).withColumn("_m", F.count("*").over(all_rows))
    stepped = raw.withColumn("_s", F.least(F.lit(1.0), (F.col("_m") - F.col("_k") + 1) * F.col("p")))
    adjusted = F.max("_s").over(W.orderBy("_k").rowsBetween(W.unboundedPreceding, 0))
    return stepped.withColumn("p_adjusted", adjusted).withColumn("rejected", F.col("p_adjusted") <= alpha).drop("_k", "_m", "_s")


def equivalence(values: DataFrame, value: str, margin: float = 0.05) -> DataFrame:
    """Equivalence by two one-sided tests: the 90 % percentile interval lies inside the margin."""
    out = quantiles(values, value, {"lower": 0.05, "upper": 0.95}).drop("n")
    return out.withColumn("equivalent", (F.col("lower") > -margin) & (F.col("upper") < margin))
