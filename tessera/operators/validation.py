"""Row and batch validation, eligibility cascades and policy rules, as columns.

Each check gives an array of the reasons against a row; a row without one is
sound. Nothing is dropped by a check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Reasons for exclusion, first match wins.
EXCLUSION_REASONS = ("conflict_group", "degenerate_value", "entangled_surface", "human_rejected", "unverified")
SPLITS = ("calibration", "development", "test")
STATUSES = ("EVALUABLE", "NOT_EVALUABLE", "NOT_APPLICABLE")
STRATA = ("EMPIRICAL", "SYNTHETIC", "REPLAYED")
HEX64 = "^[a-f0-9]{64}$"


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail; a check that is null fails."""
    marks = F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in checks.items()))
    return F.filter(marks, lambda x: x.isNotNull())


def exclusion_reasons(atoms: DataFrame, require_verified: bool = True) -> DataFrame:
    """atoms (with the frame's `text`) and their exclusion_reason, null where eligible; whether their value has several roles is looked up, or read off `conflict` where they have it."""
    start, end = F.col("char_start"), F.col("char_end")
    hyphen = ((start > 0) & (F.substring("text", start, F.lit(1)) == "-")) | (F.substring("text", end + 1, F.lit(1)) == "-")
    whole = F.length(F.trim("surface_form")) >= F.length(F.trim("text"))
    roles = F.size(F.collect_set("role").over(W.partitionBy("document_id", "canonical_value")))
    conflict = F.col("conflict") if "conflict" in atoms.columns else roles > 1
    marked = atoms.withColumn("_entangled", hyphen | whole).withColumn("_conflict", conflict)  # the text is read before the shuffle, which need not carry it
    reason = (
        F.when(F.col("_conflict"), EXCLUSION_REASONS[0])
        .when(F.trim("canonical_value") == "", EXCLUSION_REASONS[1])
        .when(F.col("_entangled"), EXCLUSION_REASONS[2])
        .when(F.col("verification") == "rejected", EXCLUSION_REASONS[3])
    )
    if require_verified:
        reason = reason.when(~F.col("verification").eqNullSafe("accepted"), EXCLUSION_REASONS[4])
    return marked.withColumn("exclusion_reason", reason).drop("_entangled", "_conflict")


def with_conflicts(lists: DataFrame) -> DataFrame:
    """Documents' lists of atoms as rows with `conflict`, whether the value has several roles in the document: nothing is shuffled.

    Such values are neighbours among the document's sorted pairs of value and role.
    """
    pairs = lists.withColumn("_pairs", F.sort_array(F.transform("atoms", lambda a: F.struct(a["canonical_value"].alias("value"), a["role"].alias("role")))))
    before = lambda i: F.element_at("_pairs", F.greatest(i, F.lit(1)))
    differs = lambda x, i: (i > 0) & (before(i)["value"] == x["value"]) & (before(i)["role"] != x["role"])
    found = pairs.withColumn("_conflicts", F.transform(F.filter("_pairs", differs), lambda x: x["value"]))
    rows = found.select(*(c for c in lists.columns if c != "atoms"), "_conflicts", F.inline("atoms"))
    return rows.withColumn("conflict", F.array_contains("_conflicts", F.col("canonical_value"))).drop("_conflicts")


def exclusion_rates(marked: DataFrame) -> DataFrame:
    """The share of all atoms under each of the five reasons, 0 where none."""
    spark = marked.sparkSession
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, EXCLUSION_REASONS))).alias("exclusion_reason"))
    counts = marked.groupBy("exclusion_reason").agg(F.count("*").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(W.partitionBy(F.lit(1))))  # a row for each reason: the atoms are worked out once
    out = names.join(counts, "exclusion_reason", "left")
    return out.select("exclusion_reason", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("rate"))


def apply_review(atoms: DataFrame, decisions: DataFrame) -> DataFrame:
    """atoms with the review's decision; an unknown or absent decision keeps the status."""
    known = decisions.select("atom_id", F.lower(F.trim("decision")).alias("_d"))
    status = F.when(F.col("_d").isin("accepted", "accept"), "accepted").when(F.col("_d").isin("rejected", "reject"), "rejected")
    return atoms.join(known, "atom_id", "left").withColumn("verification", F.coalesce(status, "verification")).drop("_d")


def frame_violations(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """Atoms whose span does not lie in their frame or does not hold their surface form."""
    return violations_in(atoms.join(frames.select("document_id", "text"), "document_id", "left"))


def violations_in(framed: DataFrame) -> DataFrame:
    """The same of atoms that have their frame's `text`, null without one."""
    inside = (F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= F.length("text"))
    same = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("surface_form")
    checks = {"no_frame": F.col("text").isNotNull(), "out_of_bounds": inside, "surface_mismatch": same}
    return framed.withColumn("violations", reasons(checks)).where(F.size("violations") > 0)


def outcome_violations(outcomes: DataFrame) -> DataFrame:
    """outcomes with the rules that each row breaks."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    checks = {
        "document_id_hash": F.length(text("document_id_hash")) >= 16,
        "split": F.col("split").isin(*SPLITS),
        "evidence_stratum": F.col("evidence_stratum").isin(*STRATA),
        "evaluable_status": F.col("evaluable_status").isin(*STATUSES),
        "receiver_config_hash": F.length(text("receiver_config_hash")) >= 16,
        "logical_evaluation_id": F.trim(text("logical_evaluation_id")) != "",
        "raw_response_sha256": F.lower(F.trim(text("raw_response_sha256"))).rlike(HEX64),
        "metric_name": F.trim(text("metric_name")) != "",
        "realized_tokens": F.col("realized_tokens").isNull() | (F.col("realized_tokens") >= 0),
        "outer_fold": F.col("outer_fold").isNull() | (F.col("outer_fold") >= 0),
    }
    return outcomes.withColumn("violations", reasons(checks))


def batch_violations(outcomes: DataFrame, least: int = 10) -> DataFrame:
    """For each (policy, metric): repeated documents, shared lineage and values that never vary."""
    grouped = outcomes.groupBy("policy_id", "metric_name").agg(
        F.count("*").alias("n"), F.count_distinct("document_id_hash").alias("docs"), F.count_distinct("logical_evaluation_id").alias("evals"),
        F.count_distinct("raw_response_sha256").alias("shas"), F.count("metric_value").alias("values"), F.min("metric_value").alias("low"), F.max("metric_value").alias("high"),
    )
    checks = {
        "duplicate_document": F.col("docs") == F.col("n"),
        "shared_evaluation": (F.col("n") <= 1) | (F.col("evals") == F.col("n")),
        "shared_response": (F.col("n") <= 1) | (F.col("shas") == F.col("n")),
        "invariant_values": (F.col("values") < least) | (F.col("low") != F.col("high")),
    }
    return grouped.withColumn("violations", reasons(checks)).select("policy_id", "metric_name", "n", "violations")


def untraced_estimates(results: DataFrame) -> DataFrame:
    """Results stated as COMPLETE, with an estimate, that name no raw response or no evaluated cell; and what they lack."""
    named = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    stated = results.where((F.col("status") == "COMPLETE") & F.col("estimate").isNotNull())
    return stated.withColumn("violations", reasons({c: named(c) for c in ("raw_response_sha256", "cell_id")})).where(F.size("violations") > 0)


def missing_fields(rows: DataFrame, names: list[str]) -> Column:
    """The names of columns that are null or empty."""
    return reasons({n: F.col(n).isNotNull() & (F.col(n).cast("string") != "") for n in names})


#: Registry fields that must be filled, and the tolerance where none is given.
REGISTRY_FIELDS = ("repository", "revision", "licence", "checkpoint", "native_metric", "native_expected")
DEFAULT_TOLERANCE = 2.0


def registry_eligibility(entries: DataFrame) -> DataFrame:
    """entries with eligible and the first reason against."""
    unresolved = missing_fields(entries, [f for f in REGISTRY_FIELDS if f in entries.columns])
    tolerance = F.coalesce(F.nullif("reproduction_tolerance", F.lit(0.0)), F.lit(DEFAULT_TOLERANCE))
    control = F.col("role") == "CONTROL"
    reason = (
        F.when(control & (F.col("status") != "READY"), "status")
        .when(control, "control")
        .when(F.col("role") == "ENDPOINT_ONLY", "endpoint_only")
        .when(F.col("role") == "RETIRED_PRE_OUTCOME", "retired")
        .when(F.col("role") == "CONTINGENCY_CAUSAL", "contingency")
        .when(F.size(unresolved) > 0, "unresolved")
        .when(F.col("status") != "READY", "status")
        .when(~F.coalesce(F.col("produces_text"), F.lit(False)), "not_textual")
        .when(F.col("native_reproduced_metric").isNull(), "not_reproduced")
        .when(F.col("reproduction_deviation").isNull(), "no_deviation")
        .when(F.abs("reproduction_deviation") > tolerance, "unreproduced")
        .otherwise("eligible")
    )
    return entries.withColumn("reason", reason).withColumn("eligible", F.col("reason").isin("control", "eligible"))


def family_of(entries: DataFrame, declared: DataFrame) -> DataFrame:
    """entries with their family: the declared block, else the entry's own, else its name."""
    block = declared.select("name", F.col("family").alias("_family"))
    return entries.join(block, "name", "left").withColumn("family", F.coalesce("_family", F.nullif("method_family", F.lit("")), "name")).drop("_family")


#: Providers and the actions of each policy rule.
PROVIDERS = ("mock", "openai", "deepseek", "anthropic", "gemini")
REAL_STAGES = ("run_stage1", "run_stage2_dev", "run_stage2_test", "run_experiment_c", "run_multihop")
POST_GATE = REAL_STAGES[1:]


def policy_decision(requests: DataFrame) -> DataFrame:
    """requests with every reason to deny and whether none holds.

    Columns: provider, subject, action, mode, protocol_freeze_present,
    relay_model_pinned, receiver_model_pinned, stage1_gate_passed,
    calibration_parameters_resolved, unmet_freeze (array of strings).
    """
    action = F.col("action")
    real, late, final = action.isin(*REAL_STAGES), action.isin(*POST_GATE), action == "run_stage2_test"
    checks = {
        "provider": F.col("provider").isin(*PROVIDERS),
        "browser_read_only": (F.col("subject") != "browser") | (action == "run_demo_synthetic"),
        "frozen_parameter": action != "mutate_frozen_parameter",
        "guardrails": action != "enable_guardrails_in_inference",
        "demo_mode": (action != "run_demo_synthetic") | (F.col("mode") == "DEMO_MODE"),
        "protocol_freeze": ~real | F.col("protocol_freeze_present"),
        "relay_pinned": ~real | F.col("relay_model_pinned"),
        "receiver_pinned": ~real | F.col("receiver_model_pinned"),
        "stage1_gate": ~late | F.col("stage1_gate_passed"),
        "calibration": ~action.isin("run_stage2_dev", "run_stage2_test") | F.col("calibration_parameters_resolved"),
    }
    unmet = F.when(final, F.transform(F.coalesce("unmet_freeze", F.array().cast("array<string>")), lambda x: F.concat(F.lit("freeze:"), x))).otherwise(F.array().cast("array<string>"))
    out = requests.withColumn("reasons", F.concat(reasons(checks), unmet))
    return out.withColumn("allow", F.size("reasons") == 0)


def endpoint_violations(pairs: DataFrame, applicable: DataFrame) -> DataFrame:
    """(family, metric) pairs that no rule allows."""
    return pairs.join(applicable, ["family", "metric"], "left_anti")


def typed_absence(rows: DataFrame, value: str, estimable: str) -> DataFrame:
    """ESTIMATED where there is a value, else NOT_ESTIMATED, or NOT_APPLICABLE where it could not be."""
    state = F.when(F.col(value).isNotNull(), "ESTIMATED").when(F.coalesce(F.col(estimable), F.lit(False)), "NOT_ESTIMATED").otherwise("NOT_APPLICABLE")
    return rows.withColumn("state", state)


#: Parts of names that tell an outcome; a policy may see none.
POST_TREATMENT = ("r_minus", "d_plus", "delta", "surplus_label", "receiver", "recovered", "y_obs", "outcome", "intervention", "transmitted", "skeleton")


def assert_pretreatment(features: DataFrame | list[str]) -> None:
    names = features.columns if isinstance(features, DataFrame) else features
    for name in names:
        if bad := [part for part in POST_TREATMENT if part in name.casefold()]:
            raise AssertionError(f"feature {name!r} holds the post-treatment name {bad[0]!r}")


def assert_not_test(split: str) -> None:
    if "test" in split.casefold() and "dev" not in split.casefold():
        raise AssertionError(f"split {split!r} must not be used for fitting")
