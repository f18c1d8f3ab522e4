"""Sampling design: inclusion probabilities, focal draws, folds and splits.

All draws rank a hash of the seed and the row's key, so they depend neither on
row order nor on partitioning. Ranks are taken within a document or a role.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions.draws import draw

from .ranks import with_place

KEYS = ("document_id", "role")


def stratum_sizes(atoms: DataFrame) -> DataFrame:
    """atoms with stratum_size (of their role) and populated_strata (of their document)."""
    document, stratum = W.partitionBy("document_id"), W.partitionBy(*KEYS)
    return atoms.withColumns({"stratum_size": F.count("*").over(stratum), "populated_strata": F.size(F.collect_set("role").over(document))})


def inclusion_probabilities(atoms: DataFrame, k: int = 3) -> DataFrame:
    """pi = (k / m)(1 / n_s) of every atom; documents of under k roles are left out."""
    sized = stratum_sizes(atoms).where(F.col("populated_strata") >= k)
    return sized.withColumns({"pi": F.lit(float(k)) / F.col("populated_strata") * (1.0 / F.col("stratum_size")), "k": F.lit(k)})


def document_eligibility(atoms: DataFrame, k: int = 3) -> DataFrame:
    roles = atoms.groupBy("document_id").agg(F.count_distinct("role").alias("n_roles"))
    return roles.withColumn("eligible", F.col("n_roles") >= k)


def select_focal(atoms: DataFrame, seed: int, k: int = 3) -> DataFrame:
    """k roles of each eligible document, and one atom of each."""
    sized = inclusion_probabilities(atoms, k)
    in_stratum = W.partitionBy(*KEYS).orderBy(draw(seed, F.col("document_id"), F.col("atom_id")), "atom_id")
    ones = sized.withColumn("_place", F.row_number().over(in_stratum)).where("_place = 1")
    of_roles = W.partitionBy("document_id").orderBy(draw(seed, F.col("document_id"), F.col("role")), "role")
    return ones.withColumn("_place", F.row_number().over(of_roles)).where(F.col("_place") <= k).drop("_place")


def select_focal_of(lists: DataFrame, seed: int, k: int = 3) -> DataFrame:
    """select_focal() of documents whose atoms are a list (atom_lists()): their other columns, the atom's, and pi, without a shuffle."""
    document = F.col("document_id")

    def stratum(role):
        mine = F.filter("atoms", lambda a: a["role"] == role)
        ranked = F.transform(mine, lambda a: F.struct(draw(seed, document, a["atom_id"]).alias("place"), a["atom_id"].alias("atom_id"), a.alias("atom")))
        return F.struct(draw(seed, document, role).alias("place"), role.alias("role"), F.size(mine).alias("n"), F.array_min(ranked)["atom"].alias("atom"))

    roles = F.array_distinct(F.transform("atoms", lambda a: a["role"]))
    strata = lists.withColumn("_m", F.size(roles)).where(F.col("_m") >= k).withColumn("_focal", F.explode(F.slice(F.array_sort(F.transform(roles, stratum)), 1, k)))
    pi = F.lit(float(k)) / F.col("_m") * (1.0 / F.col("_focal.n"))
    return strata.select(*(F.col(c) for c in lists.columns if c not in ("atoms", "document_id")), "document_id", pi.alias("pi"), *(F.col(f"_focal.atom.{c}").alias(c) for c in lists.schema["atoms"].dataType.elementType.names if c != "document_id"))


def allocation(roles: list[str], n: list[int], cap: int) -> list[int]:
    """How many of each role's n are taken, `cap` in all; roles in sorted order."""
    total = sum(n)
    if total <= cap:
        return n
    share = [cap * x / total for x in n]
    take = [max(1, int(s)) for s in share]
    while sum(take) > cap:
        most = max((i for i in range(len(n)) if take[i] > 1), key=lambda i: (take[i] - share[i], roles[i]), default=None)
        if most is None:
            break
        take[most] -= 1
    while sum(take) < cap:
        least = max((i for i in range(len(n)) if take[i] < n[i]), key=lambda i: (share[i] - take[i], roles[i]), default=None)
        if least is None:
            break
        take[least] += 1
    return [min(t, x) for t, x in zip(take, n)]


def instrumentation_plan(atoms: DataFrame, seed: int, cap: int = 30) -> DataFrame:
    """atoms with q and selected: at most `cap` for each document, by role.

    A document of `cap` atoms or fewer is taken whole. Otherwise a role gets
    its proportional share rounded down, at least one; then single draws are
    taken from the role most above its share, or given to the one most below,
    the later name first among equals. That loop runs over the roles of one
    document, a handful of rows.
    """
    if cap <= 0:
        raise ValueError("cap must be positive")
    sizes = atoms.groupBy(*KEYS).agg(F.count("*").alias("n"))
    per_document = sizes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("role", "n"))).alias("sizes"))

    @F.pandas_udf("array<long>")
    def takes_of(s):
        return s.map(lambda roles: allocation([r["role"] for r in roles], [int(r["n"]) for r in roles], cap))

    zipped = per_document.select("document_id", F.explode(F.arrays_zip("sizes", takes_of("sizes").alias("take"))).alias("z"))
    takes = zipped.select("document_id", "z.sizes.role", "z.sizes.n", "z.take")
    place = F.row_number().over(W.partitionBy(*KEYS).orderBy(draw(seed, F.col("document_id"), F.col("atom_id")), "atom_id"))
    joined = atoms.join(takes, list(KEYS)).withColumn("_place", place)
    return joined.withColumns({"q": F.col("take") / F.col("n"), "selected": F.col("_place") <= F.col("take")}).drop("_place", "n", "take")


def grouped_folds(rows: DataFrame, folds: int) -> DataFrame:
    """rows with the fold of their document: its place among the sorted documents, modulo the folds.

    With fewer documents than folds there are as many folds as documents, two at least.
    """
    documents = with_place(rows.select("document_id").distinct(), ["document_id"], "_place")
    n = documents.count()
    used = folds if n >= folds else max(2, n)
    return rows.join(documents.select("document_id", (F.col("_place") % used).cast("int").alias("fold")), "document_id")


def split_partition(documents: DataFrame, seed: int, sizes: dict[str, int]) -> DataFrame:
    """documents with the split whose range of the hashed order they fall in; the rest are left out."""
    place = F.row_number().over(W.orderBy(draw(seed, F.col("document_id")), "document_id"))
    total, split = 0, F.lit(None).cast("string")
    ranges = []
    for name, n in sizes.items():
        ranges.append((name, total, total + n))
        total += n
    best = documents.select("document_id").distinct().withColumn("_h", draw(seed, F.col("document_id"))).orderBy("_h", "document_id").limit(total)
    for name, low, high in ranges:
        split = F.when((F.col("_place") > low) & (F.col("_place") <= high), name).otherwise(split)
    return best.withColumn("_place", place).select("document_id", split.alias("split"))


def role_sample(atoms: DataFrame, seed: int, n: int) -> DataFrame:
    """The first n atoms of each role in the hashed order."""
    place = F.row_number().over(W.partitionBy("role").orderBy(draw(seed, F.col("document_id"), F.col("atom_id")), "document_id", "atom_id"))
    return atoms.withColumn("place", place).where(F.col("place") <= n)


def splits_overlap(splits: DataFrame) -> DataFrame:
    """Documents in more than one split; a clean partition has none."""
    return splits.groupBy("document_id").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def reserve_order(items: DataFrame, truth: str, position: str, n: int = 100) -> DataFrame:
    """The first n items of each truth value in the frozen order of `position`, with their place there; nulls of truth are left out."""
    place = F.row_number().over(W.partitionBy(truth).orderBy(position))
    return items.where(F.col(truth).isNotNull()).withColumn("place", place).where(F.col("place") <= n)
