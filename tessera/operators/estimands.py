"""Design-weighted estimates over causal records, as single-pass aggregations.

A record is a focal atom with its inclusion probability pi (and second-stage
q), whether it was transmitted, and its recovery with and without the atom in
the message. Every estimate is a ratio of sums, so one grouped aggregation
gives all of them; what does not exist is null, never zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .inference import FINAL_REPLICATES, replicate_sums

#: Slack for inclusion probabilities that rounding puts just above one.
PI_SLACK = 1e-12


def design_weight(pi: Column, q: Column | None = None) -> Column:
    """1 / pi, or 1 / (pi q) for two phases; improper probabilities raise an error."""
    bad = pi.isNull() | F.isnan(pi) | (pi <= 0) | (pi > 1 + PI_SLACK)
    if q is None:
        return F.when(bad, F.raise_error(F.lit("pi must lie in (0, 1]")).cast("double")).otherwise(1 / pi)
    bad = bad | q.isNull() | (q <= 0)
    return F.when(bad, F.raise_error(F.lit("pi must lie in (0, 1] and q above 0")).cast("double")).otherwise(1 / (pi * q))


def with_derived(records: DataFrame) -> DataFrame:
    """records with delta_avail, y_obs and sign."""
    t = F.col("transmitted")
    return records.withColumns({"delta_avail": F.col("d_plus") - F.col("r_minus"), "y_obs": F.when(t == 1, F.col("d_plus")).otherwise(F.col("r_minus")), "sign": 2 * t - 1})


def hajek(value: Column, weight: Column) -> Column:
    """Sum of w x over sum of w; null where the weights sum to nothing."""
    return F.sum(weight * value) / F.nullif(F.sum(weight), F.lit(0.0))


def horvitz_thompson(value: Column, weight: Column, population: int) -> Column:
    if population <= 0:
        raise ValueError("the population size must be positive")
    return F.sum(weight * value) / F.lit(float(population))


def weighted_covariance(x: Column, y: Column, weight: Column) -> Column:
    return hajek(x * y, weight) - hajek(x, weight) * hajek(y, weight)


def _sums(two_phase: bool) -> list[Column]:
    w = design_weight(F.col("pi"), F.col("q") if two_phase else None)
    t, r, d = F.col("transmitted").cast("double"), F.col("r_minus"), F.col("d_plus")
    parts = {
        "w": w, "wt": w * t, "wr": w * r, "wy": w * F.when(t == 1, d).otherwise(r), "wd": w * (d - r), "wtd": w * t * (d - r),
        "wtr": w * t * r, "w0r": w * (1 - t) * r, "w0": w * F.when(t == 0, 1.0).otherwise(0.0), "wneg": w * F.when(d - r < 0, 1.0).otherwise(0.0),
    }
    return [F.sum(v).alias(f"s_{k}") for k, v in parts.items()]


def _estimates(atom_level: bool) -> dict[str, Column]:
    s = {k: F.col(f"s_{k}") for k in ("w", "wt", "wr", "wy", "wd", "wtd", "wtr", "w0r", "w0", "wneg")}
    a, r0, t, d = s["wy"] / s["w"], s["wr"] / s["w"], s["wt"] / s["w"], s["wd"] / s["w"]
    alignment = s["wtd"] / s["w"] - t * d
    r_obs = F.when(s["w0"] > 0, s["w0r"] / s["w0"])
    both = (s["w0"] > 0) & (s["wt"] > 0) & (t > 0) & (t < 1)
    bias = F.when(both, r_obs - r0)
    by_covariance = F.when(both, -(s["wtr"] / s["w"] - t * r0) / (1 - t))
    by_conditionals = F.when(both, t * (r_obs - s["wtr"] / s["wt"]))
    gap = F.when(both, F.greatest(F.abs(bias - by_covariance), F.abs(bias - by_conditionals), F.abs(by_covariance - by_conditionals)))
    return {
        "endpoint_fidelity": a, "r_bar_zero": r0, "t_bar": t, "delta_bar": d, "volume": t * d, "alignment": alignment, "c_comm": a - r0, "c_recon": s["w0r"] / s["w"],
        "phi": F.when(a > 0, (a - r0) / a), "r_observational": r_obs, "selection_bias": bias, "selection_bias_identity": by_covariance,
        "selection_bias_conditional": by_conditionals, "selection_bias_max_discrepancy": gap,
        "prob_delta_negative": s["wneg"] / s["w"] if atom_level else F.lit(None).cast("double"), "identity_residual": a - (r0 + t * d + alignment),
    }


def decompose(records: DataFrame, by: list[str] | None = None, two_phase: bool = False, atom_level: bool = True) -> DataFrame:
    """The decomposition for each group: A = R0 + T D + Cov(T, D), with its 18 figures.

    Groups are those that occur; no records at all give no row. Rows are
    summed for each document of a group first, so that documents are counted
    over those sums, in the tasks that hold them, and not shuffled again.
    """
    by = by or []
    partial = records.groupBy(*dict.fromkeys(["document_id", *by])).agg(F.count("*").alias("n"), *_sums(two_phase))
    names = [c for c in partial.columns if c.startswith("s_")]
    grouped = partial.groupBy(*by).agg(F.sum("n").alias("n_atoms"), F.count("document_id").alias("n_documents"), *(F.sum(c).alias(c) for c in names)).where("n_atoms > 0")
    return grouped.select(*by, "n_atoms", "n_documents", *(v.alias(k) for k, v in _estimates(atom_level).items()))


def decompose_by_role(records: DataFrame, **kw) -> DataFrame:
    """Each role's decomposition and the pooled one (role `pooled`).

    Rows are summed for each (document, role) first, so that the grouping sets
    expand those sums only, and the records are worked out once. A document
    counts in the whole by the first of its roles.
    """
    two_phase, atom_level = kw.get("two_phase", False), kw.get("atom_level", True)
    partial = records.groupBy("document_id", "role").agg(F.count("*").alias("n"), *_sums(two_phase))
    names = [c for c in partial.columns if c.startswith("s_")]
    first = F.row_number().over(W.partitionBy("document_id").orderBy("role")) == 1
    counted = partial.withColumns({"_each": F.when(F.col("document_id").isNotNull(), 1).otherwise(0), "_first": F.when(F.col("document_id").isNotNull() & first, 1).otherwise(0)})
    sums = counted.rollup("role").agg(F.grouping("role").alias("all_roles"), *(F.sum(c).alias(c) for c in ("n", "_each", "_first", *names)))
    whole = F.col("all_roles") == 1
    n_documents = F.when(whole, F.coalesce("_first", F.lit(0))).otherwise(F.col("_each"))
    return sums.select(F.when(whole, "pooled").otherwise(F.col("role")).alias("role"), F.col("n").alias("n_atoms"), n_documents.alias("n_documents"), *(v.alias(k) for k, v in _estimates(atom_level).items()))


def divergence_by_hop(records: DataFrame, hop: str = "hop") -> DataFrame:
    """A, T and A - T for each hop."""
    return decompose(records, [hop]).select(hop, "endpoint_fidelity", "t_bar", (F.col("endpoint_fidelity") - F.col("t_bar")).alias("divergence"))


def stratum_discrepancy(records: DataFrame, value: str, stratum: str = "role") -> DataFrame:
    """Sum over strata of (weight share - row share) times the stratum's mean."""
    w = design_weight(F.col("pi"))
    strata = records.groupBy(stratum).agg(F.sum(w).alias("sw"), F.count("*").alias("n"), F.sum(w * F.col(value)).alias("swx"))
    total = strata.agg(F.sum("sw").alias("tw"), F.sum("n").alias("tn"))
    each = strata.crossJoin(F.broadcast(total))  # one row
    return each.agg(F.sum((F.col("sw") / F.col("tw") - F.col("n") / F.col("tn")) * F.col("swx") / F.col("sw")).alias("discrepancy"))


def sham_estimate(pairs: DataFrame, by: str = "mechanism") -> DataFrame:
    """Mean of sham minus natural outcome for each mechanism."""
    return pairs.groupBy(by).agg(F.avg(F.col("sham") - F.col("natural")).alias("epsilon_mechanical"), F.count("*").alias("n"))


def population_region(records: DataFrame, epsilon_del: float, epsilon_ins: float, epsilon_bar: float) -> DataFrame:
    """Raw and sham-corrected surplus and its region, for deletions, insertions and both.

    The second-stage q plays no part here. A mechanism without records gives no row.
    """
    if epsilon_bar < 0:
        raise ValueError("epsilon_bar must not be negative")
    w, t = design_weight(F.col("pi")), F.col("transmitted")
    delta = F.col("d_plus") - F.col("r_minus")
    corrected = delta + (2 * t - 1) * F.when(t == 1, epsilon_del).otherwise(epsilon_ins)
    sums = records.groupBy(F.when(t == 1, "del").otherwise("ins").alias("mechanism")).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * delta).alias("wd"), F.sum(w * corrected).alias("wc"))
    pooled = sums.agg(*(F.sum(c).alias(c) for c in ("n", "w", "wd", "wc"))).where("n > 0").select(F.lit("pooled").alias("mechanism"), "*")
    out = sums.unionByName(pooled).withColumns({"point_raw": F.col("wd") / F.col("w"), "point_corrected": F.col("wc") / F.col("w")})
    out = out.withColumns({"lower": F.greatest(F.lit(-1.0), F.col("point_corrected") - epsilon_bar), "upper": F.least(F.lit(1.0), F.col("point_corrected") + epsilon_bar)})
    return out.select("mechanism", "point_raw", "point_corrected", "lower", "upper", F.lit(epsilon_bar).alias("epsilon_bar"), "n", ((F.col("lower") > 0) | (F.col("upper") < 0)).alias("excludes_zero"))


def atom_region(records: DataFrame, epsilon_mech: float, epsilon_bar: float, u_bar: float) -> DataFrame:
    """Each atom's region: its corrected surplus give or take epsilon_bar + u_bar."""
    if epsilon_bar < 0 or u_bar < 0:
        raise ValueError("bounds must not be negative")
    centre = F.col("d_plus") - F.col("r_minus") + (2 * F.col("transmitted") - 1) * epsilon_mech
    half = epsilon_bar + u_bar
    return records.withColumns({"lower": F.greatest(F.lit(-1.0), centre - half), "upper": F.least(F.lit(1.0), centre + half)})


def failure_rates(edits: DataFrame, most_overall: float = 0.15, most_gap: float = 0.05) -> DataFrame:
    """Edit failures overall and by arm, and whether both stay within their limits."""
    failed = F.when(F.col("accepted"), 0.0).otherwise(1.0)
    out = edits.agg(F.avg(failed).alias("overall"), F.avg(F.when(F.col("transmitted") == 1, failed)).alias("transmitted_rate"), F.avg(F.when(F.col("transmitted") == 0, failed)).alias("omitted_rate"))
    gap = F.abs(F.col("transmitted_rate") - F.col("omitted_rate"))
    return out.withColumn("differential", gap).withColumn("passed", (F.col("overall") <= most_overall) & (F.coalesce(gap, F.lit(0.0)) <= most_gap))


def stage_gate(reconstruction: Column, effects: Column, classes: tuple[str, ...] = ("scope", "period", "numeric"), recon_gate: float = 0.10, prior_gate: float = 0.10) -> Column:
    """Proceed where reconstruction or any eligible class's prior effect reaches its gate.

    effects: map of class to effect; an absent or null effect clears nothing.
    """
    cleared = F.exists(F.array(*(F.lit(c) for c in classes)), lambda c: F.coalesce(F.element_at(effects, c) >= prior_gate, F.lit(False)))
    return cleared | F.coalesce(reconstruction >= recon_gate, F.lit(False))


def matched_contrast(slots: DataFrame, by: list[str]) -> DataFrame:
    """Mean of natural minus mean of blocked outcomes for each slot."""
    arm = lambda name: F.avg(F.when(F.col("arm") == name, F.col("outcome")))
    return slots.groupBy(*by).agg(arm("natural").alias("natural"), arm("blocked").alias("blocked")).withColumn("contrast", F.col("natural") - F.col("blocked"))


def mean_of_means(outcomes: DataFrame, role: str, atom: list[str], value: str) -> DataFrame:
    """For each role the mean over atoms of each atom's mean."""
    per_atom = outcomes.groupBy(role, *atom).agg(F.avg(value).alias("_mean"))
    return per_atom.groupBy(role).agg(F.avg("_mean").alias("prior_effect"), F.count("*").alias("n_atoms"))


#: The least effect that counts as prior access.
PRIOR_THRESHOLD = 0.10


def matched_prior_estimates(slots: DataFrame, roles: list[str], replicates: int = FINAL_REPLICATES, seed: int = 0) -> DataFrame:
    """For each role the effect of prior access over its focal, compliant slots: one row even where there are none.

    slots: (document_id, role, y_nat, y_blk, pi, is_focal, is_compliant). The
    estimate is the design-weighted mean of natural minus blocked, with the
    95 % interval of its document bootstrap; a role without a slot is
    NOT_ESTIMABLE and has nulls.
    """
    used = slots.where(F.col("is_focal") & F.col("is_compliant") & F.col("role").isin(*roles))
    w = design_weight(F.col("pi"))
    rows = used.select("document_id", "role", "y_nat", "y_blk", (F.col("y_nat") - F.col("y_blk")).alias("gap"), w.alias("w"))
    counted = [F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in ("y_nat", "y_blk", "gap") for k, f in (("s", F.sum), ("n", F.count)))]
    sums = rows.groupBy("document_id", "role").agg(F.sum(F.col("w") * F.col("gap")).alias("a"), F.sum("w").alias("b"), *counted)
    mean = lambda c: F.sum(f"s_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))
    points = sums.groupBy("role").agg(  # one row of sums for each document of a role
        F.sum("n").alias("n_slots"), F.count("document_id").alias("n_documents"), mean("y_nat").alias("r_natural"), mean("y_blk").alias("r_blocked"),
        (F.sum("a") / F.sum("b")).alias("estimate"), mean("gap").alias("unweighted_mean"),
    )
    values = replicate_sums(sums, ["a", "b"], replicates, seed, ["role"]).where("b > 0").select("role", (F.col("a") / F.col("b")).alias("v"))
    ends = values.groupBy("role").agg(F.percentile("v", F.lit(0.025)).alias("lower"), F.percentile("v", F.lit(0.975)).alias("upper"))
    every = slots.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, roles))).alias("role"))
    out = every.join(points, "role", "left").join(ends, "role", "left")
    status = F.when(F.col("n_slots").isNull(), "NOT_ESTIMABLE").otherwise("ESTIMABLE")
    counted = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_slots", "n_documents")}
    return out.withColumns(counted | {"status": status, "clears_threshold": F.coalesce(F.col("estimate") >= PRIOR_THRESHOLD, F.lit(False))})
