"""Calibration rules, audits, probes and token budgets."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions.draws import draw
from tessera.functions.text import pieces

from .quantiles import quantiles

#: The budget grid and its target ratio, the tolerance grid and floor, the subset grid and limits.
BUDGET_GRID, TARGET_RHO = (200, 250, 300, 400, 500), 2.0
RETENTION_FLOOR = 0.80
SUBSET_GRID, CALL_SHARE = (50, 100, 150, 200), 0.15
#: Repeats to choose from, the share of document variance that decoding may add, an audit's least size.
REPLICATION_GRID, DECODE_SHARE = (1, 2, 3, 5), 0.10
AUDIT_INPUTS, AUDIT_REPEATS = 100, 10
#: Probe bins.
BINS = ("low", "medium", "high")


def primary_budget(costs: DataFrame, cost: str = "cost", grid: tuple[int, ...] = BUDGET_GRID, rho: float = TARGET_RHO) -> DataFrame:
    """The budget whose median cost ratio is nearest the target; the larger of equals."""
    middle = quantiles(costs, cost, {"m": 0.5})
    medians = middle.select(F.explode(F.array(*map(F.lit, grid))).alias("budget"), "m", F.col("n").alias("n_documents")).where("n_documents > 0")
    medians = medians.select("budget", (F.col("m") / F.col("budget")).alias("median_rho"), "n_documents")
    place = F.row_number().over(W.orderBy(F.abs(F.col("median_rho") - rho), F.col("budget").desc()))
    return medians.withColumn("_k", place).where("_k = 1").drop("_k")


def receiver_budgets(costs: DataFrame) -> DataFrame:
    """The three budgets from each receiver's median cost: F/2, F/1.5 and 200 for the median F of medians."""
    medians = quantiles(costs, "cost", {"m": 0.5}, ["receiver"])
    return medians.agg(F.median("m").alias("f_star")).select("f_star", F.bround(F.col("f_star") / 2).cast("int").alias("b1"), F.bround(F.col("f_star") / 1.5).cast("int").alias("b2"), F.lit(200).alias("b3"))


def eviction_tolerance(retention: DataFrame, floor: float = RETENTION_FLOOR) -> DataFrame:
    """The least tolerance that keeps the floor's share of pairs; null if none does."""
    return retention.agg(F.min(F.when(F.col("retention") >= floor, F.col("tolerance"))).alias("tolerance"))


def subset_choice(grid: DataFrame, median_candidates: int, call_budget: int, retention: float, share: float = CALL_SHARE, floor: float = RETENTION_FLOOR, calls: int = 2) -> DataFrame:
    """grid (n) with projected calls, the reason against each size and the one chosen: the largest without one."""
    ceiling = int(call_budget * share)
    out = grid.withColumn("projected_calls", F.col("n") * median_candidates * calls)
    reason = F.when(F.lit(retention < floor), "retention").when(F.col("projected_calls") > ceiling, "calls")
    out = out.withColumn("reason", reason)
    best = F.max(F.when(F.col("reason").isNull(), F.col("n"))).over(W.partitionBy(F.lit(1)))
    return out.withColumn("chosen", F.coalesce(F.col("n") == best, F.lit(False)))


def bin_of(p: Column) -> Column:
    """low, medium or high by thirds; a third belongs to the bin above it."""
    return F.when(p < 1 / 3, BINS[0]).when(p < 2 / 3, BINS[1]).when(p.isNotNull(), BINS[2])


def prior_probes(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Share of successes of each probe, its binomial error and its bin."""
    out = outcomes.groupBy(*by).agg(F.sum("success").alias("successes"), F.count("*").alias("m_prior"))
    p = F.col("successes") / F.col("m_prior")
    out = out.withColumn("p_hat", p)
    return out.withColumns({"binomial_se": F.sqrt(F.greatest(F.col("p_hat") * (1 - F.col("p_hat")), F.lit(0.0)) / F.col("m_prior")), "bin": bin_of(F.col("p_hat"))})


def dose_response(probes: DataFrame, outcome: str) -> DataFrame:
    """Mean outcome and count of each bin, and whether the means of the bins that have any rise.

    A bin without a probe has count 0 and a null mean.
    """
    spark = probes.sparkSession
    bins = spark.range(len(BINS)).select(F.element_at(F.array(*map(F.lit, BINS)), (F.col("id") + 1).cast("int")).alias("bin"), F.col("id").alias("_k"))
    means = probes.groupBy("bin").agg(F.avg(outcome).alias("mean"), F.count(outcome).alias("n"))
    joined = bins.join(means, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    before = F.last("mean", ignorenulls=True).over(W.orderBy("_k").rowsBetween(W.unboundedPreceding, -1))
    falls = F.coalesce(F.col("mean") < before - 1e-12, F.lit(False)).cast("int")
    stepped = joined.withColumn("_falls", falls)
    return stepped.withColumn("monotone_increasing", F.max("_falls").over(W.partitionBy(F.lit(1))) == 0).select("bin", "mean", "n", "monotone_increasing")


def order_invariance(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.agg(F.avg(F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)).alias("agreement"), F.count("*").alias("n"))


def determinism_audit(outputs: DataFrame, by_repeats: bool = False) -> DataFrame:
    """Prompts whose repeats all agree, and the regime: D if all do, else S.

    outputs: (prompt, output). Prompts of unequal repeats, or of one, give the regime INVALID.
    With `by_repeats`, a row for each number of repeats.
    """
    per = outputs.groupBy("prompt").agg(F.count("*").alias("repeats"), F.count_distinct("output").alias("kinds"))
    groups = per.groupBy(F.col("repeats").alias("_group")) if by_repeats else per.groupBy()
    out = groups.agg(F.count("*").alias("n_prompts"), F.min("repeats").alias("repeats"), F.max("repeats").alias("_most"), F.count_if(F.col("kinds") > 1).alias("n_disagreeing"))
    out = out.withColumn("exact_agreement_rate", 1 - F.col("n_disagreeing") / F.nullif("n_prompts", F.lit(0)))
    invalid = F.col("repeats").isNull() | (F.col("repeats") != F.col("_most")) | (F.col("repeats") < 2)
    return out.withColumn("regime", F.when(invalid, "INVALID").when(F.col("exact_agreement_rate") >= 1.0, "D").otherwise("S")).drop("_most", "_group")


def reproducibility_regime(outcomes: DataFrame, inputs: int = AUDIT_INPUTS, repeats: int = AUDIT_REPEATS) -> DataFrame:
    """NOT_AUDITED for an undersized audit; else confirmed by whether any input disagrees with itself."""
    per = outcomes.groupBy("input_id").agg(F.count("*").alias("m"), F.count_distinct("outcome").alias("kinds"))
    out = per.agg(F.count("*").alias("n_inputs"), F.min("m").alias("n_repeats"), F.count_if(F.col("kinds") > 1).alias("inputs_with_disagreement"))
    small = (F.col("n_inputs") < inputs) | F.coalesce(F.col("n_repeats") < repeats, F.lit(True))
    return out.withColumn("regime", F.when(small, "NOT_AUDITED").when(F.col("inputs_with_disagreement") == 0, "D_CONFIRMED").otherwise("S_CONFIRMED"))


def replication_rule(outcomes: DataFrame) -> DataFrame:
    """The least number of repeats that brings decoding variance under its share of document variance.

    outcomes: (input_id, value). Decoding variance is the mean population
    variance within inputs, document variance the sample variance of their means.
    """
    per = outcomes.groupBy("input_id").agg(F.var_pop("value").alias("v"), F.avg("value").alias("m"))
    out = per.agg(F.avg("v").alias("sigma2_decode"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("sigma2_document"))
    return out.withColumns(replication_columns(F.col("sigma2_decode"), F.col("sigma2_document")))


def replication_columns(decode: Column, document: Column) -> dict[str, Column]:
    grid = F.array(*map(F.lit, REPLICATION_GRID))
    fit = F.array_min(F.filter(grid, lambda m: decode / m <= DECODE_SHARE * document))
    flat = document == 0
    met = F.when(flat, decode == 0).otherwise(fit.isNotNull())
    m_star = F.when(flat, F.when(decode > 0, REPLICATION_GRID[-1]).otherwise(REPLICATION_GRID[0])).otherwise(F.coalesce(fit, F.lit(REPLICATION_GRID[-1])))
    ratio = F.when(flat, F.when(decode > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(decode / F.nullif(document, F.lit(0.0)))
    return {"ratio": ratio, "m_star": m_star, "criterion_met": met, "hierarchical_bootstrap_required": ~met}


def repeat_identity(outputs: DataFrame) -> DataFrame:
    """Share of repeats that equal their input's first byte for byte, and of inputs whose canonical outcomes agree.

    outputs: (input_id, repeat, output, outcome).
    """
    first = F.first("output").over(W.partitionBy("input_id").orderBy("repeat"))
    place = F.row_number().over(W.partitionBy("input_id").orderBy("repeat"))
    marked = outputs.withColumns({"_first": first, "_k": place})
    per = marked.groupBy("input_id").agg(F.sum(F.when((F.col("_k") > 1) & (F.col("output") == F.col("_first")), 1).otherwise(0)).alias("same"), (F.count("*") - 1).alias("later"), F.count_distinct("outcome").alias("kinds"))
    return per.agg((F.sum("same") / F.nullif(F.sum("later"), F.lit(0))).alias("byte_identity_rate"), F.avg(F.when(F.col("kinds") == 1, 1.0).otherwise(0.0)).alias("canonical_unanimity_rate"))


def knapsack(items: list[tuple[str, int, float]], budget: int) -> tuple[list[str], int, float, int]:
    """Chosen ids, their cost and utility, and ties: the best choice within the budget.

    Items are taken in the order of (cost, id) and only where that is strictly
    better, so the choice is the same for any input order.
    """
    if budget < 0:
        raise ValueError("budget must not be negative")
    ordered = sorted(items, key=lambda x: (x[1], x[0]))
    best = np.zeros(budget + 1)
    taken = np.zeros((len(ordered), budget + 1), dtype=bool)
    ties = 0
    for i, (_, cost, utility) in enumerate(ordered):
        if not 0 <= cost <= budget:
            continue
        with_it = best[: budget + 1 - cost] + utility
        ties += int((with_it == best[cost:]).sum())
        taken[i, cost:] = with_it > best[cost:]
        best = np.concatenate([best[:cost], np.maximum(best[cost:], with_it)])
    chosen, left = [], budget
    for i in range(len(ordered) - 1, -1, -1):
        if taken[i, left]:
            chosen.append(ordered[i])
            left -= ordered[i][1]
    return sorted(x[0] for x in chosen), sum(x[1] for x in chosen), float(best[budget]), ties


def greedy_fill(costs: list[int], budget: int, order: np.ndarray) -> list[int]:
    """Items taken in the given order where they still fit."""
    left, out = budget, []
    for i in order:
        if costs[i] <= left:
            out.append(int(i))
            left -= costs[i]
    return out


def targeting(candidates: DataFrame, budget: int, seed: int = 0, draws: int = 512) -> DataFrame:
    """For each document observed, random-fill and best utility, their ratio, and Cov(T, delta).

    candidates: (document_id, atom_id, transmitted, delta_budget,
    rendered_tokens, value). The ratio is null where the best is no better
    than random fills. A document's candidates are gathered into one row.
    """
    kind = candidates.schema["document_id"].dataType.simpleString()
    fields = ("atom_id", "transmitted", "delta_budget", "rendered_tokens", "value")
    listed = candidates.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))

    names = ["g_obs", "g_rand", "g_star", "eta_u", "ties_broken", "n_candidates", "cov_t_delta"]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in pieces(batches):
            sizes, flat = batch.column(1).value_lengths().to_numpy(), batch.column(1).flatten()
            starts = np.cumsum(sizes) - sizes
            cost = pc.struct_field(flat, "rendered_tokens")
            if cost.null_count:
                raise ValueError("a candidate without tokens")
            cost, ids = cost.to_numpy(zero_copy_only=False).astype(np.int64), pc.struct_field(flat, "atom_id").to_pylist()
            t, d, v = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("transmitted", "delta_budget", "value"))
            out = np.zeros((len(sizes), len(names)))
            for n in np.unique(sizes):  # documents of one size are solved side by side
                rows = np.flatnonzero(sizes == n)
                at = starts[rows][:, None] + np.arange(n)
                utility = v[at] * d[at]
                placed = np.array([sorted(x, key=lambda i: (cost[i], ids[i])) for x in at.tolist()])
                best, ties = best_values(cost[placed], v[placed] * d[placed], budget)
                fill = mean_fills(cost[at], utility, budget, seed, draws)
                cov = np.mean(t[at] * d[at], axis=1) - t[at].mean(axis=1) * d[at].mean(axis=1)
                observed = np.where(t[at] == 1, utility, 0.0).sum(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[rows] = np.column_stack([observed, fill, best, (observed - fill) / (best - fill), ties, np.full(len(rows), n), cov])
            null = ~(out[:, 2] > out[:, 1])
            columns = [pa.array(x.astype(np.int64)) if c in ("ties_broken", "n_candidates") else pa.array(x, mask=null if c == "eta_u" else None) for c, x in zip(names, out.T)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["document_id", *names])

    return listed.mapInArrow(run, f"document_id {kind}, g_obs double, g_rand double, g_star double, eta_u double, ties_broken long, n_candidates long, cov_t_delta double")


def best_values(costs: np.ndarray, utility: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The best utility within the budget and the ties met, as knapsack() has them, for many documents (rows) of as many items in its order."""
    best, ties = np.zeros((len(costs), budget + 1)), np.zeros(len(costs), dtype=np.int64)
    for cost, gain in zip(costs.T, utility.T):
        before = np.arange(budget + 1) - cost[:, None]
        can = (before >= 0) & (cost[:, None] >= 0)
        with_it = np.where(can, np.take_along_axis(best, np.clip(before, 0, budget), axis=1) + gain[:, None], -np.inf)
        ties += (can & (with_it == best)).sum(axis=1)
        best = np.maximum(best, with_it)
    return best[:, budget], ties


@lru_cache(maxsize=32)
def _orders(n: int, seed: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """The different orders among the drawn ones of n items, and which of them each draw is; they depend on n alone."""
    rng = np.random.default_rng(seed)
    return np.unique(np.array([rng.permutation(n) for _ in range(draws)]).reshape(draws, n), axis=0, return_inverse=True)


def mean_fills(costs: np.ndarray, utility: np.ndarray, budget: int, seed: int, draws: int) -> np.ndarray:
    """The mean utility of greedy fills in drawn orders, for many documents (rows) of as many items."""
    if not draws:
        return np.zeros(len(costs))
    orders, of = _orders(costs.shape[1], seed, draws)
    left, total = np.full((len(costs), len(orders)), budget), np.zeros((len(costs), len(orders)))
    for items in orders.T:
        fits = costs[:, items] <= left
        left -= np.where(fits, costs[:, items], 0)
        total += np.where(fits, utility[:, items], 0.0)
    return np.ascontiguousarray(total[:, of.reshape(-1)]).mean(axis=1)


def targeting_covariance(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Observed utility and population covariance of transmission and budget-neutral surplus."""
    t, d = F.col("transmitted").cast("double"), F.col("delta_budget")
    return candidates.groupBy(*by).agg(F.sum(F.when(t == 1, F.col("value") * d).otherwise(0.0)).alias("g_obs"), F.covar_pop(t, d).alias("cov_t_delta"), F.count("*").alias("n_candidates"))


def interaction_diagnostic(pairs: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Mean |with - without| against mean |delta|: infinite where no delta differs from zero."""
    out = pairs.agg(F.count("*").alias("n_pairs"), F.avg(F.abs(F.col("with_partner") - F.col("without_partner"))).alias("mean_abs_interaction"), F.coalesce(F.avg(F.abs("delta")), F.lit(0.0)).alias("mean_abs_delta"))
    ratio = F.when(F.col("mean_abs_delta") > 0, F.col("mean_abs_interaction") / F.col("mean_abs_delta")).otherwise(F.lit(float("inf")))
    return out.withColumn("ratio", ratio).withColumn("additivity_supported", F.col("ratio") <= threshold)


def eviction_partners(atoms: DataFrame, tolerance: int) -> DataFrame:
    """For each atom the other atom of its document to evict for it, within the token tolerance.

    The nearest in tokens, then of another role, then by id. Token counts are
    bucketed by tolerance + 1 so that the join is by equality on three
    neighbouring buckets instead of over all pairs of a document.
    """
    width = tolerance + 1
    bucket = F.floor(F.col("tokens") / width)
    left = atoms.select("document_id", F.col("atom_id").alias("focal_id"), F.col("role").alias("focal_role"), F.col("tokens").alias("focal_tokens"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    right = atoms.select("document_id", F.col("atom_id").alias("partner_id"), "role", "tokens", bucket.alias("_b"))
    distance = F.abs(F.col("tokens") - F.col("focal_tokens"))
    near = left.join(right, ["document_id", "_b"]).where((F.col("partner_id") != F.col("focal_id")) & (distance <= tolerance))
    order = F.struct(distance.alias("distance"), (F.col("role") == F.col("focal_role")).alias("same_role"), F.col("partner_id").alias("partner_id"))
    best = near.groupBy("document_id", "focal_id").agg(F.min(order).alias("b"))
    return best.select("document_id", "focal_id", "b.partner_id", "b.distance", "b.same_role")


def retention_by_tolerance(atoms: DataFrame, grid: tuple[int, ...] = (0, 1, 2, 3, 5)) -> DataFrame:
    """The share of atoms with a partner at each tolerance, from one join at the widest."""
    best = eviction_partners(atoms, max(grid)).select("distance")
    n = atoms.count()
    kept = best.select(F.explode(F.array(*map(F.lit, grid))).alias("tolerance"), "distance").groupBy("tolerance").agg(F.count_if(F.col("distance") <= F.col("tolerance")).alias("kept"))
    return kept.select("tolerance", (F.col("kept") / F.lit(float(n))).alias("retention"))


def uniform_atoms(atoms: DataFrame, budget: int, seed: int) -> DataFrame:
    """Atoms of each document taken in a hashed order where they still fit the budget.

    atoms: (document_id, atom_id, cost).
    """
    ordered = F.sort_array(F.collect_list(F.struct(draw(seed, F.col("document_id"), F.col("atom_id")).alias("h"), "atom_id", "cost")))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<string>").alias("ids"))

    def step(state, item):
        fits = state["spent"] + item["cost"] <= budget
        return F.when(fits, F.struct((state["spent"] + item["cost"]).cast("long").alias("spent"), F.concat(state["ids"], F.array(item["atom_id"].cast("string"))).alias("ids"))).otherwise(state)

    filled = atoms.groupBy("document_id").agg(ordered.alias("items")).withColumn("s", F.aggregate("items", start, step))
    return filled.select("document_id", F.col("s.spent").alias("spent"), F.size("s.ids").alias("n_chosen"), F.array_join(F.array_sort("s.ids"), ",").alias("chosen"))
