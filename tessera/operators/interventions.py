"""Matched skeletons, their blocked arms, and budgeted allocations of atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions.atoms import render
from tessera.functions.draws import draw
from tessera.functions.text import count_tokens
from tessera.schemas import ROLES

from .calibration import knapsack

#: The mark of the slot left out, and the least roles of a tuple.
OMITTED, LEAST_ROLES = "[OMITTED]", 3


def candidate_tuples(atoms: DataFrame, least: int = LEAST_ROLES) -> DataFrame:
    """One row for each slot of each sentence of at least `least` roles: the role's first atom there."""
    first = F.row_number().over(W.partitionBy("document_id", "sentence_index", "role").orderBy("char_start", "atom_id"))
    ones = atoms.withColumn("_k", first).where("_k = 1").drop("_k")
    n = F.count("*").over(W.partitionBy("document_id", "sentence_index"))
    slots = ones.withColumn("n_roles", n).where(F.col("n_roles") >= least)
    return slots.withColumn("slot_id", F.concat_ws(":", "document_id", F.lit("tuple"), "sentence_index"))


def _place(role: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLES)), role)


def skeletons(slots: DataFrame, value: str = "canonical_value", name: str = "skeleton") -> DataFrame:
    """For each tuple and focal role the lines of all slots, the focal one left out."""
    whole = slots.groupBy("slot_id").agg(F.sort_array(F.collect_list(F.struct(_place(F.col("role")).alias("k"), "role", F.col(value).alias("value")))).alias("slots"))
    focal = slots.select("slot_id", "document_id", "sentence_index", F.col("role").alias("focal_role"), F.col("canonical_value").alias("focal_value")).join(whole, "slot_id")
    lines = F.transform("slots", lambda s: render(s["role"], F.when(s["role"] == F.col("focal_role"), OMITTED).otherwise(s["value"])))
    return focal.withColumn(name, F.array_join(lines, "\n")).drop("slots")


def blocked_values(slots: DataFrame, support: DataFrame, seed: int) -> DataFrame:
    """slots with blocked_value: another value of the role's support, by the hash of the slot.

    support: (role, value), a bounded vocabulary, sorted into one array for
    each role; the pick is by place, stepping over the natural value, so no
    pair of slot and vocabulary is formed. A role without another value keeps
    a null.
    """
    listed = support.select("role", "value").distinct().groupBy("role").agg(F.sort_array(F.collect_list("value")).alias("_values"))
    joined = slots.join(listed, "role", "left")
    others = F.filter("_values", lambda v: v != F.col("canonical_value"))
    place = draw(seed, F.col("slot_id"), F.col("role"))
    return joined.withColumn("_others", others).withColumn("blocked_value", F.when(F.size("_others") > 0, F.element_at("_others", (place % F.size("_others") + 1).cast("int")))).drop("_values", "_others")


def signature(skeleton: Column) -> Column:
    """Slots in order with values erased; two matched arms share it."""
    return F.transform(F.split(skeleton, "\n"), lambda x: F.concat(F.regexp_extract(x, "^- ([a-z]+): (.*)$", 1), F.when(F.regexp_extract(x, "^- ([a-z]+): (.*)$", 2) == OMITTED, ":OMITTED").otherwise(":VALUE")))


def matched_arms(slots: DataFrame) -> DataFrame:
    """natural and blocked skeletons side by side, and whether they match: same slots, one left out in each."""
    fields = F.struct(_place(F.col("role")).alias("k"), "role", F.col("canonical_value").alias("value"), "blocked_value", "document_id", "sentence_index")
    whole = slots.groupBy("slot_id").agg(F.sort_array(F.collect_list(fields)).alias("slots"))
    focal = whole.select("slot_id", "slots", F.explode("slots").alias("focal"))  # a join of the slots with themselves would work them out for each side
    lines = lambda field: F.array_join(F.transform("slots", lambda s: render(s["role"], F.when(s["role"] == F.col("focal.role"), OMITTED).otherwise(s[field]))), "\n")
    names = [F.col(f"focal.{c}").alias(n) for c, n in (("document_id", "document_id"), ("sentence_index", "sentence_index"), ("role", "focal_role"), ("value", "focal_value"))]
    both = focal.select("slot_id", *names, lines("value").alias("natural"), lines("blocked_value").alias("blocked"))
    once = lambda c: F.size(F.split(c, r"\[OMITTED\]")) == 2
    return both.withColumn("matched", (signature(F.col("natural")) == signature(F.col("blocked"))) & once("natural") & once("blocked"))


def allocate(atoms: DataFrame, budget: int, score: str = "score") -> DataFrame:
    """For each document the message of the atoms of highest predicted utility within the budget.

    Utilities below zero count as zero and are never taken. The message's own
    tokens are counted at the end and the lowest scores dropped while it is
    over. A document's atoms are gathered into one row.
    """
    fields = ("atom_id", "role", "canonical_value", "char_start", score)
    return allocate_of(atoms.groupBy("document_id").agg(F.collect_list(F.struct(*fields)).alias("items")), budget, score)


def allocate_of(lists: DataFrame, budget: int, score: str = "score") -> DataFrame:
    """The same of (document_id, items), an array of structs (atom_id, role, canonical_value, char_start, score) for each document."""
    listed = lists.select("document_id", F.sort_array("items").alias("items"))

    def message(items) -> str:
        ordered = sorted(items, key=lambda i: (i["char_start"], i["role"], i["atom_id"]))
        return "\n".join(f"- {i['role']}: {i['canonical_value']}" for i in ordered)

    def solve(items) -> tuple:
        costs = [count_tokens(f"- {i['role']}: {i['canonical_value']}\n") for i in items]
        chosen, _, _, ties = knapsack([(i["atom_id"], c, max(0.0, i[score])) for i, c in zip(items, costs)], budget)
        kept = set(chosen)
        picked = sorted((i for i in items if i["atom_id"] in kept), key=lambda i: (i[score], i["atom_id"]))
        while picked and count_tokens(message(picked)) > budget:
            picked.pop(0)
        text = message(picked)
        return text, count_tokens(text), float(sum(max(0.0, i[score]) for i in picked)), len(picked), ties

    def run(frames):
        import pandas as pd

        for frame in frames:
            solved = pd.DataFrame([solve(x) for x in frame["items"]], columns=["message", "tokens", "utility", "n_chosen", "ties_broken"])
            yield pd.concat([frame[["document_id"]].reset_index(drop=True), solved], axis=1)

    return listed.mapInPandas(run, "document_id string, message string, tokens int, utility double, n_chosen int, ties_broken int")


def replicate_means(outcomes: DataFrame, by: list[str]) -> DataFrame:
    return outcomes.groupBy(*by).agg(F.avg("outcome").alias("outcome"), F.count("*").alias("n_replicates"))
