"""Queries over the star schema for the estimators, designs, audits and logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.draws import draw, draw_sql
from tessera.operators import calibration, design, estimands, inference, intervals, learning, resampling, trees, validation
from tessera.operators.quantiles import quantiles
from tessera.streaming import events

from .adapters import ORDER_ATOMS, PROVIDER_CALLS, RECORDS, RUN_EVENTS, STAGED_EVENTS, order_atoms, provider_calls, read, records, run_events, staged_events

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places: engines add in different orders."""
    return df.select(*((F.round(c, 9) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def r9(expression: str, name: str) -> str:
    return f"round({expression}, 9) + 0e0 AS {name}"


# Estimates.

_SUMS = """count(*) AS n_atoms, count(DISTINCT document_id) AS n_documents, sum(w) AS sw, sum(w * transmitted) AS swt, sum(w * r_minus) AS swr,
    sum(w * y) AS swy, sum(w * (d_plus - r_minus)) AS swd, sum(w * transmitted * (d_plus - r_minus)) AS swtd, sum(w * transmitted * r_minus) AS swtr,
    sum(w * (1 - transmitted) * r_minus) AS sw0r, sum(w * (1 - transmitted)) AS sw0, sum(CASE WHEN d_plus < r_minus THEN w ELSE 0e0 END) AS swneg"""
_COLUMNS = [
    ("a", "endpoint_fidelity"), ("r0", "r_bar_zero"), ("t", "t_bar"), ("d", "delta_bar"), ("t * d", "volume"), ("al", "alignment"), ("a - r0", "c_comm"), ("sw0r / sw", "c_recon"),
    ("CASE WHEN a > 0 THEN (a - r0) / a END", "phi"), ("ro", "r_observational"), ("CASE WHEN both_arms THEN ro - r0 END", "selection_bias"),
    ("CASE WHEN both_arms THEN -(swtr / sw - t * r0) / (1 - t) END", "selection_bias_identity"), ("CASE WHEN both_arms THEN t * (ro - swtr / swt) END", "selection_bias_conditional"),
    ("CASE WHEN both_arms THEN 0e0 END", "selection_bias_max_discrepancy"), ("swneg / sw", "prob_delta_negative"), ("0e0", "identity_residual"),
]


def decompose_sql(select: str, group: str, two_phase: bool = False) -> str:
    w = "1e0 / (pi * q)" if two_phase else "1e0 / pi"
    keys = select + ", " if select else ""
    name = select.split(" AS ")[-1] + ", " if select else ""
    return f"""WITH {RECORDS}, weighted AS (SELECT *, {w} AS w, CASE WHEN transmitted = 1 THEN d_plus ELSE r_minus END AS y FROM records),
        sums AS (SELECT {keys}{_SUMS} FROM weighted {group}),
        means AS (SELECT *, swy / sw AS a, swr / sw AS r0, swt / sw AS t, swd / sw AS d, swtd / sw - (swt / sw) * (swd / sw) AS al,
            CASE WHEN sw0 > 0 THEN sw0r / sw0 END AS ro, sw0 > 0 AND swt > 0 AS both_arms FROM sums)
        SELECT {name}n_atoms, n_documents, {", ".join(r9(e, n) for e, n in _COLUMNS)} FROM means"""


@query(decompose_sql("", ""))
def decompose_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimands.decompose(records(spark, sf_dir)))


@query(decompose_sql("coalesce(role, 'pooled') AS role", "GROUP BY GROUPING SETS ((role), ())"))
def decompose_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimands.decompose_by_role(records(spark, sf_dir)))


@query(decompose_sql("hop", "GROUP BY hop"))
def decompose_by_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimands.decompose(records(spark, sf_dir), ["hop"]))


@query(decompose_sql("", "", two_phase=True))
def decompose_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimands.decompose(records(spark, sf_dir), two_phase=True))


@query(f"""WITH {RECORDS}, w AS (SELECT *, 1e0 / pi AS w, CASE WHEN transmitted = 1 THEN d_plus ELSE r_minus END AS y FROM records)
    SELECT hop, {r9("sum(w * y) / sum(w)", "endpoint_fidelity")}, {r9("sum(w * transmitted) / sum(w)", "t_bar")},
    {r9("sum(w * y) / sum(w) - sum(w * transmitted) / sum(w)", "divergence")} FROM w GROUP BY hop""")
def divergence_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimands.divergence_by_hop(records(spark, sf_dir)))


@query(f"WITH {RECORDS} SELECT role, {r9('sum(r_minus / pi) / sum(1e0 / pi)', 'mean')} FROM records GROUP BY role")
def hajek_mean_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = estimands.design_weight(F.col("pi"))
    return rounded(records(spark, sf_dir).groupBy("role").agg(estimands.hajek(F.col("r_minus"), w).alias("mean")))


@query(f"WITH {RECORDS} SELECT role, {r9('sum(r_minus / pi) / 1000e0', 'mean')} FROM records GROUP BY role")
def ht_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = estimands.design_weight(F.col("pi"))
    return rounded(records(spark, sf_dir).groupBy("role").agg(estimands.horvitz_thompson(F.col("r_minus"), w, 1000).alias("mean")))


@query(f"""WITH {RECORDS}, w AS (SELECT *, 1e0 / pi AS w FROM records)
    SELECT role, {r9("sum(w * d_plus * r_minus) / sum(w) - (sum(w * d_plus) / sum(w)) * (sum(w * r_minus) / sum(w))", "covariance")} FROM w GROUP BY role""")
def weighted_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = estimands.design_weight(F.col("pi"))
    return rounded(records(spark, sf_dir).groupBy("role").agg(estimands.weighted_covariance(F.col("d_plus"), F.col("r_minus"), w).alias("covariance")))


@query(f"""WITH {RECORDS}, s AS (SELECT role, sum(1e0 / pi) AS sw, count(*) AS n, sum(d_plus / pi) AS swx FROM records GROUP BY role),
    t AS (SELECT sum(sw) AS tw, sum(n) AS tn FROM s) SELECT {r9("sum((sw / tw - n / tn) * swx / sw)", "discrepancy")} FROM s, t""")
def stratum_discrepancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimands.stratum_discrepancy(records(spark, sf_dir), "d_plus"))


@query(f"WITH {RECORDS} SELECT CASE WHEN transmitted = 1 THEN 'del' ELSE 'ins' END AS mechanism, {r9('avg(d_plus - r_minus)', 'epsilon_mechanical')}, count(*) AS n FROM records GROUP BY ALL")
def sham_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = records(spark, sf_dir).select(F.when(F.col("transmitted") == 1, "del").otherwise("ins").alias("mechanism"), F.col("d_plus").alias("sham"), F.col("r_minus").alias("natural"))
    return rounded(estimands.sham_estimate(pairs))


@query(f"""WITH {RECORDS}, c AS (SELECT 1e0 / pi AS w, transmitted, d_plus - r_minus AS d, d_plus - r_minus + (2 * transmitted - 1) * CASE WHEN transmitted = 1 THEN 0.02e0 ELSE 0.03e0 END AS c FROM records),
    g AS (SELECT coalesce(mechanism, 'pooled') AS mechanism, sum(w * d) / sum(w) AS r, sum(w * c) / sum(w) AS c, count(*) AS n
        FROM (SELECT *, CASE WHEN transmitted = 1 THEN 'del' ELSE 'ins' END AS mechanism FROM c) GROUP BY GROUPING SETS ((mechanism), ()))
    SELECT mechanism, {r9("r", "point_raw")}, {r9("c", "point_corrected")}, {r9("greatest(-1e0, c - 0.05e0)", "lower")}, {r9("least(1e0, c + 0.05e0)", "upper")},
    {r9("0.05e0", "epsilon_bar")}, n, greatest(-1e0, c - 0.05e0) > 0 OR least(1e0, c + 0.05e0) < 0 AS excludes_zero FROM g""")
def population_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimands.population_region(records(spark, sf_dir), 0.02, 0.03, 0.05))


@query(f"""WITH {RECORDS} SELECT document_id, atom_id, {r9("greatest(-1e0, d_plus - r_minus + (2 * transmitted - 1) * 0.02e0 - 0.15e0)", "lower")},
    {r9("least(1e0, d_plus - r_minus + (2 * transmitted - 1) * 0.02e0 + 0.15e0)", "upper")} FROM records""")
def atom_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimands.atom_region(records(spark, sf_dir), 0.02, 0.05, 0.10).select("document_id", "atom_id", "lower", "upper"))


@query(f"""WITH {RECORDS}, f AS (SELECT avg(x) AS o, avg(CASE WHEN transmitted = 1 THEN x END) AS t, avg(CASE WHEN transmitted = 0 THEN x END) AS m
    FROM (SELECT transmitted, CASE WHEN discount < 0.01 THEN 1e0 ELSE 0e0 END AS x FROM records))
    SELECT {r9("o", "overall")}, {r9("t", "transmitted_rate")}, {r9("m", "omitted_rate")}, {r9("abs(t - m)", "differential")}, o <= 0.15 AND abs(t - m) <= 0.05 AS passed FROM f""")
def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimands.failure_rates(records(spark, sf_dir).withColumn("accepted", F.col("discount") >= 0.01)))


@query(f"""WITH {RECORDS}, d AS (SELECT document_id, sum((1 - transmitted) * r_minus / pi) / sum(1e0 / pi) AS recon FROM records GROUP BY document_id),
    e AS (SELECT document_id, max(CASE WHEN role = 'A' THEN discount END) AS a, max(CASE WHEN role = 'N' THEN discount END) AS n FROM records GROUP BY document_id)
    SELECT document_id, coalesce(a >= 0.1, false) OR coalesce(n >= 0.1, false) OR recon >= 0.1 AS proceed FROM d JOIN e USING (document_id)""")
def stage1_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    w = estimands.design_weight(F.col("pi"))
    best = lambda role: F.max(F.when(F.col("role") == role, F.col("discount")))
    per = r.groupBy("document_id").agg(estimands.hajek((1 - F.col("transmitted")) * F.col("r_minus"), w).alias("recon"), best("A").alias("a"), best("N").alias("n"))
    effects = F.create_map(F.lit("A"), F.col("a"), F.lit("N"), F.col("n"))
    return per.select("document_id", estimands.stage_gate(F.col("recon"), effects, ("A", "N")).alias("proceed"))


@query(f"""WITH {ORDER_ATOMS} SELECT document_id, role, {r9("avg(CASE WHEN transmitted = 1 THEN d_plus END)", "natural")}, {r9("avg(CASE WHEN transmitted = 0 THEN d_plus END)", "blocked")},
    {r9("avg(CASE WHEN transmitted = 1 THEN d_plus END) - avg(CASE WHEN transmitted = 0 THEN d_plus END)", "contrast")} FROM order_atoms GROUP BY document_id, role""")
def matched_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = order_atoms(spark, sf_dir).select("document_id", "role", F.when(F.col("transmitted") == 1, "natural").otherwise("blocked").alias("arm"), F.col("d_plus").alias("outcome"))
    return rounded(estimands.matched_contrast(slots, ["document_id", "role"]))


@query(f"""WITH {ORDER_ATOMS} SELECT role, {r9("avg(m)", "prior_effect")}, count(*) AS n_atoms FROM (SELECT role, document_id, avg(r_minus) AS m FROM order_atoms GROUP BY role, document_id) GROUP BY role""")
def prior_effect_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(estimands.mean_of_means(order_atoms(spark, sf_dir), "role", ["document_id"], "r_minus"))


# Designs.


@query(f"""WITH {RECORDS} SELECT document_id, atom_id, stratum_size, CAST(populated_strata AS INT) AS populated_strata,
    {r9("(2e0 / populated_strata) * (1e0 / stratum_size)", "pi")} FROM records WHERE populated_strata >= 2""")
def inclusion_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(design.inclusion_probabilities(order_atoms(spark, sf_dir), 2).select("document_id", "atom_id", "stratum_size", "populated_strata", "pi"))


@query(f"WITH {ORDER_ATOMS} SELECT document_id, count(DISTINCT role) AS n_roles, count(DISTINCT role) >= 3 AS eligible FROM order_atoms GROUP BY document_id")
def doc_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.document_eligibility(order_atoms(spark, sf_dir), 3)


@query(f"""WITH {RECORDS}, a AS (SELECT *, row_number() OVER (PARTITION BY document_id, role ORDER BY {draw_sql("'7'", "document_id", "atom_id")}, atom_id) AS i FROM records WHERE populated_strata >= 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {draw_sql("'7'", "document_id", "role")}, role) AS j FROM a WHERE i = 1)
    SELECT document_id, atom_id, role, {r9("(2e0 / populated_strata) * (1e0 / stratum_size)", "pi")} FROM b WHERE j <= 2""")
def select_focal_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(design.select_focal(order_atoms(spark, sf_dir), 7, 2).select("document_id", "atom_id", "role", "pi"))


@query()
def instrumentation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.instrumentation_plan(order_atoms(spark, sf_dir), 7, 4).select("document_id", "atom_id", "role", "q", "selected")


@query(f"""WITH {ORDER_ATOMS}, d AS (SELECT DISTINCT document_id FROM order_atoms)
    SELECT document_id, CAST((row_number() OVER (ORDER BY document_id) - 1) % 5 AS INT) AS fold FROM d""")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = order_atoms(spark, sf_dir).select("document_id").distinct()
    return design.grouped_folds(documents, 5)


_SPLIT = {"calibration": 50, "development": 100, "test": 200}


@query(f"""WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id FROM orders), h AS (SELECT document_id, row_number() OVER (ORDER BY {draw_sql("'11'", "document_id")}, document_id) AS i FROM d)
    SELECT document_id, CASE WHEN i <= 50 THEN 'calibration' WHEN i <= 150 THEN 'development' ELSE 'test' END AS split FROM h WHERE i <= 350""")
def split_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.split_partition(read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id")), 11, _SPLIT)


@query("""WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_linestatus AS split FROM lineitem)
    SELECT document_id, count(DISTINCT split) AS n_splits FROM s GROUP BY document_id HAVING count(DISTINCT split) > 1""")
def split_disjoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.splits_overlap(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_linestatus").alias("split")))


@query(f"""WITH {ORDER_ATOMS}, p AS (SELECT document_id, atom_id, role, row_number() OVER (PARTITION BY role ORDER BY {draw_sql("'3'", "document_id", "atom_id")}, document_id, atom_id) AS place FROM order_atoms)
    SELECT role, document_id, atom_id, CAST(place AS INT) AS place FROM p WHERE place <= 20""")
def role_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.role_sample(order_atoms(spark, sf_dir), 3, 20).select("role", "document_id", "atom_id", "place")


# Inference.

_STATS = """stats AS (SELECT CAST(o_custkey AS VARCHAR) AS document_id, sum(w * y) AS a, sum(w) AS b, sum(w * r_minus) AS a2 FROM
    (SELECT *, 1e0 / pi AS w, CASE WHEN transmitted = 1 THEN d_plus ELSE r_minus END AS y FROM records) JOIN orders ON document_id = CAST(o_orderkey AS VARCHAR) GROUP BY o_custkey)"""


def _taken_sql(rows: str, seed: int, replicates: int) -> str:
    """SQL for taken: the rows with how often each replicate takes their document."""
    times = " + ".join(f"CAST(u >= {limit} AS INT)" for limit in inference.TAKEN)
    bits, low = inference.HALF, (1 << inference.HALF) - 1
    return f"""replicates AS MATERIALIZED (SELECT r AS replicate, g >> {bits} AS g1, g & {low} AS g2 FROM (SELECT r, {draw_sql(f"'{seed}'", "'replicate'", "r")} AS g FROM range({replicates}) t(r))),
        keyed AS MATERIALIZED (SELECT *, h >> {bits} AS h1, h & {low} AS h2 FROM (SELECT *, {draw_sql(f"'{seed}'", "document_id")} AS h FROM {rows})),
        drawn AS (SELECT *, ((h1 * g1 + h2 * g2) % {inference.PRIME}) >> {31 - inference.DRAW_BITS} AS u FROM keyed, replicates), taken AS (SELECT *, {times} AS times FROM drawn)"""


def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums for each customer, as the clusters to resample."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), "o_custkey")
    w = estimands.design_weight(F.col("pi"))
    rows = estimands.with_derived(records(spark, sf_dir)).join(orders, "document_id")
    return rows.groupBy(F.col("o_custkey").cast("string").alias("document_id")).agg(F.sum(w * F.col("y_obs")).alias("a"), F.sum(w).alias("b"), F.sum(w * F.col("r_minus")).alias("a2"))


@query(f"""WITH {RECORDS}, {_STATS}, {_taken_sql("stats", 5, inference.FINAL_REPLICATES)}, v AS (SELECT sum(times * a) / sum(times * b) AS v FROM taken GROUP BY replicate)
    SELECT {r9("(SELECT sum(a) / sum(b) FROM stats)", "point")}, {r9("quantile_cont(v, 0.025)", "lower")}, {r9("quantile_cont(v, 0.975)", "upper")}, count(*) AS n_replicates, (SELECT count(*) FROM stats) AS n_documents FROM v""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.bootstrap_ratio(cluster_stats(spark, sf_dir), "a", "b", seed=5))


@query(f"""WITH {RECORDS}, {_STATS}, {_taken_sql("stats", 6, inference.FINAL_REPLICATES)}, v AS (SELECT sum(times * a) / sum(times * b) - sum(times * a2) / sum(times * b) AS v FROM taken GROUP BY replicate)
    SELECT {r9("(SELECT sum(a) / sum(b) - sum(a2) / sum(b) FROM stats)", "point")}, {r9("quantile_cont(v, 0.025)", "lower")}, {r9("quantile_cont(v, 0.975)", "upper")}, count(*) AS n_replicates, (SELECT count(*) FROM stats) AS n_documents FROM v""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cluster_stats(spark, sf_dir)
    second = stats.select("document_id", F.col("a2").alias("a"), "b")
    return rounded(inference.paired_bootstrap(stats, second, "a", "b", seed=6))


def comparator_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four comparators' differences for each supplier, from the moments of its lines."""
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("document_id")).agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    names = F.array(*(F.struct(F.lit(f"m{i}").alias("comparator"), F.lit(0.01 * i).alias("shift")) for i in range(4)))
    return per.select("document_id", F.explode(names).alias("c"), "d", "t").select("document_id", "c.comparator", (F.col("d") - F.col("c.shift")).alias("delta_a"), (F.col("t") - F.col("c.shift")).alias("delta_c"))


_DIFFERENCES = """diffs AS (SELECT CAST(l_suppkey AS VARCHAR) AS document_id, concat('m', i) AS comparator, avg(l_discount) - 0.01e0 * i AS delta_a, avg(l_tax) - 0.01e0 * i AS delta_c
    FROM lineitem, range(4) t(i) GROUP BY l_suppkey, i)"""
_MAXSTAT = f"""WITH {_DIFFERENCES}, docs AS (SELECT DISTINCT document_id FROM diffs), size AS (SELECT count(*) AS n FROM docs),
    {_taken_sql("diffs", 42, inference.FINAL_REPLICATES)}, points AS (SELECT comparator, avg(delta_a) AS pa, avg(delta_c) AS pc FROM diffs GROUP BY comparator),
    means AS (SELECT replicate, comparator, sum(times * delta_a) / sum(times) AS ma, sum(times * delta_c) / sum(times) AS mc FROM taken GROUP BY replicate, comparator HAVING sum(times) > 0),
    worst AS (SELECT replicate, max(pa - ma) AS wa, max(pc - mc) AS wc FROM means JOIN points USING (comparator) GROUP BY replicate),
    cut AS (SELECT quantile_cont(wa, 0.95) AS ca, quantile_cont(wc, 0.95) AS cc FROM worst),
    bounds AS (SELECT comparator, n AS n_documents, pa, pa - ca AS la, pc, pc - cc AS lc FROM points, cut, size)"""


@query(f"""{_MAXSTAT} SELECT comparator, n_documents, {r9("pa", "point_a")}, {r9("la", "lower_a")}, {r9("pc", "point_c")}, {r9("lc", "lower_c")}, pa > 0 AND pc > 0 AS directional_win, la > 0 AND lc > 0 AS simultaneous_win,
    CASE WHEN min(CAST(la > 0 AND lc > 0 AS INT)) OVER () = 1 THEN 'PASS' ELSE 'NOT_ESTABLISHED' END AS verdict FROM bounds""")
def maxstat_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.simultaneous_bootstrap(comparator_differences(spark, sf_dir), seed=42))


@query(f"""{_MAXSTAT}, named AS (SELECT comparator, la > 0 AND lc > 0 AS won, CASE WHEN comparator IN ('m0', 'm1') THEN 'f0' ELSE comparator END AS family FROM bounds),
    t AS (SELECT count(*) FILTER (won) AS n_wins, count(*) FILTER (NOT won) AS n_losses, count(*) AS n_eligible, count(DISTINCT family) AS n_families, count(DISTINCT CASE WHEN won THEN family END) AS n_winning_families FROM named)
    SELECT *, n_families >= 3 AS headline_eligible, CASE WHEN n_families = 3 THEN n_eligible ELSE 3 END AS wins_needed,
    n_families >= 3 AND n_wins >= CASE WHEN n_families = 3 THEN n_eligible ELSE 3 END AND n_winning_families >= 3 AS permitted FROM t""")
def superiority_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = inference.simultaneous_bootstrap(comparator_differences(spark, sf_dir), seed=42)
    names = spark.range(4).select(F.concat(F.lit("m"), "id").alias("comparator"))
    families = names.where("comparator IN ('m0', 'm1')").withColumn("family", F.lit("f0"))
    return inference.superiority(bounds.select("comparator", "lower_a", "lower_c"), names, families, names)


_BALANCES = """spent AS (SELECT concat_ws('-', c_nationkey, c_mktsegment) AS document_id, c_acctbal AS v FROM customer)"""
_ORDERED = f"""WITH {_BALANCES}, {_taken_sql("spent", 21, inference.FINAL_REPLICATES)}, whole AS (SELECT -1 AS replicate, v, 1 AS times FROM spent),
    every AS (SELECT replicate, v, times FROM taken WHERE times > 0 UNION ALL SELECT * FROM whole),
    counted AS (SELECT replicate, v, CAST(sum(times) AS BIGINT) AS times FROM every GROUP BY replicate, v),
    along AS (SELECT *, sum(times) OVER (PARTITION BY replicate ORDER BY v) AS upto, sum(times) OVER (PARTITION BY replicate) AS n FROM counted)"""
_ENDS = f"""SELECT {r9("max(v) FILTER (replicate < 0)", "point")}, (SELECT count(DISTINCT document_id) FROM spent) AS n_documents, {r9("quantile_cont(v, 0.025) FILTER (replicate >= 0)", "lower")},
    {r9("quantile_cont(v, 0.975) FILTER (replicate >= 0)", "upper")}, count(*) FILTER (replicate >= 0) AS n_replicates FROM found"""


def _spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances, in clusters of a nation and a segment, the documents to resample."""
    return read(spark, sf_dir, "customer").select(F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("document_id"), F.col("c_acctbal").alias("v"))


@query(f"""{_ORDERED}, found AS (SELECT replicate, sum(v * CASE WHEN upto > floor((n - 1) / 2e0) AND upto - times <= floor((n - 1) / 2e0) THEN 0.5e0 ELSE 0 END
    + v * CASE WHEN upto > ceil((n - 1) / 2e0) AND upto - times <= ceil((n - 1) / 2e0) THEN 0.5e0 ELSE 0 END) AS v FROM along GROUP BY replicate) {_ENDS}""")
def median_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.bootstrap(_spent(spark, sf_dir), resampling.quantile(F.col("v"), 0.5), seed=21))


@query(f"""{_ORDERED}, found AS (SELECT replicate, sum(v * greatest(0, least(upto, n - floor(n * 0.1e0)) - greatest(upto - times, floor(n * 0.1e0)))) / max(n - 2 * floor(n * 0.1e0)) AS v FROM along GROUP BY replicate) {_ENDS}""")
def trimmed_mean_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resampling.bootstrap(_spent(spark, sf_dir), resampling.trimmed_mean(F.col("v"), 0.1), seed=21))


@query(f"""WITH rows AS (SELECT CAST(l_suppkey AS VARCHAR) AS document_id, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
    sums AS (SELECT document_id, count(*) AS c, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy FROM rows GROUP BY document_id), {_taken_sql("sums", 22, inference.FINAL_REPLICATES)},
    every AS (SELECT replicate, c, x, y, xx, yy, xy, times FROM taken UNION ALL SELECT -1, c, x, y, xx, yy, xy, 1 FROM sums),
    t AS (SELECT replicate, sum(times * c) AS n, sum(times * x) AS x, sum(times * y) AS y, sum(times * xx) AS xx, sum(times * yy) AS yy, sum(times * xy) AS xy FROM every GROUP BY replicate),
    found AS (SELECT replicate, (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) AS v FROM t WHERE n > 0), spent AS (SELECT document_id FROM sums) {_ENDS}""")
def correlation_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("document_id"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return rounded(resampling.bootstrap(rows, resampling.correlation(F.col("x"), F.col("y")), seed=22))


@query("""SELECT l_returnflag AS flag, """ + ", ".join(r9(f"quantile_cont(CAST(l_extendedprice AS DOUBLE), {p})", name) for name, p in (("p05", 0.05), ("p50", 0.5), ("p99", 0.99))) + """, count(l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag""")
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return rounded(quantiles(rows, "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p99": 0.99}, ["flag"]))


@query(f"""WITH {ORDER_ATOMS}, c AS (SELECT role, sum(transmitted) AS s, CAST(count(*) AS DOUBLE) AS n FROM order_atoms GROUP BY role),
    p AS (SELECT role, s / n AS p, n, 1.959963984540054e0 * 1.959963984540054e0 AS z FROM c),
    q AS (SELECT role, (p + z / (2 * n)) / (1 + z / n) AS m, 1.959963984540054e0 * sqrt(p * (1 - p) / n + z / (4 * n * n)) / (1 + z / n) AS h FROM p)
    SELECT role, {r9("greatest(0e0, m - h)", "lower")}, {r9("least(1e0, m + h)", "upper")} FROM q""")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = order_atoms(spark, sf_dir).groupBy("role").agg(F.sum("transmitted").alias("s"), F.count("*").alias("n"))
    low, high = inference.wilson(F.col("s"), F.col("n"))
    return rounded(counts.select("role", low.alias("lower"), high.alias("upper")))


@query(f"""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS total, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c),
    e AS (SELECT sum(na * nb) AS chance FROM (SELECT a AS label, sum(n) AS na FROM c GROUP BY a) JOIN (SELECT b AS label, sum(n) AS nb FROM c GROUP BY b) USING (label)),
    o AS (SELECT total, same / total AS ob, chance / (total * total) AS ex FROM t, e)
    SELECT CAST(total AS BIGINT) AS n, {r9("ob", "observed")}, {r9("ex", "expected")}, {r9("CASE WHEN ex >= 1 THEN 1e0 ELSE (ob - ex) / (1 - ex) END", "kappa")} FROM o""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.cohen_kappa(read(spark, sf_dir, "labels"), "quality", "toxic"))


@query(f"""WITH {ORDER_ATOMS}, p AS (SELECT role, tokens > 25 AS p, transmitted = 1 AS t FROM order_atoms),
    c AS (SELECT role, count(*) AS n, count(*) FILTER (t) AS n_presence, count(*) FILTER (NOT t) AS n_absence, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp,
        count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM p GROUP BY role)
    SELECT *, {r9("coalesce(tp / nullif(tp + fp, 0), 1e0)", "precision")}, {r9("coalesce(tp / nullif(tp + fn, 0), 1e0)", "recall")}, tp / (tp + fp) >= 0.98 AND tp / (tp + fn) >= 0.95 AND n_presence >= 100 AND n_absence >= 100 AS passed FROM c""")
def matcher_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.confusion(order_atoms(spark, sf_dir).select("role", (F.col("tokens") > 25).alias("p"), (F.col("transmitted") == 1).alias("t")), "p", "t", ["role"]))


@query(f"""WITH p AS (SELECT event_type AS name, avg(CASE WHEN value > 20 THEN 1e0 ELSE 0e0 END) / 10 AS p FROM events GROUP BY event_type),
    k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM p),
    s AS (SELECT *, max(least(1e0, (m - k + 1) * p)) OVER (ORDER BY k) AS pa FROM k) SELECT name, {r9("p", "p")}, {r9("pa", "p_adjusted")}, pa <= 0.05 AS rejected FROM s""")
def holm_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg((F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)) / 10).alias("p"))
    return rounded(inference.holm(tests))


@query(f"""SELECT {r9("quantile_cont(l_discount - 0.05e0, 0.05)", "lower")}, {r9("quantile_cont(l_discount - 0.05e0, 0.95)", "upper")},
    quantile_cont(l_discount - 0.05e0, 0.05) > -0.05 AND quantile_cont(l_discount - 0.05e0, 0.95) < 0.05 AS equivalent FROM lineitem""")
def sham_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.equivalence(read(spark, sf_dir, "lineitem").select((F.col("l_discount") - 0.05).alias("v")), "v"))


# Calibration and audits.


@query(f"""WITH c AS (SELECT l_orderkey, CAST(sum(l_quantity) AS INT) AS cost FROM lineitem GROUP BY l_orderkey), m AS (SELECT b AS budget, median(cost / CAST(b AS DOUBLE)) AS rho, count(*) AS n FROM c, (VALUES (200), (250), (300), (400), (500)) g(b) GROUP BY b)
    SELECT budget, {r9("rho", "median_rho")}, n AS n_documents FROM m ORDER BY abs(rho - 2), budget DESC LIMIT 1""")
def budget_bstar(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("cost"))
    return rounded(calibration.primary_budget(costs))


@query(f"""WITH m AS (SELECT l_returnflag, median(l_quantity * 6) AS m FROM lineitem GROUP BY l_returnflag), f AS (SELECT median(m) AS f FROM m)
    SELECT {r9("f", "f_star")}, CAST(round_even(f / 2, 0) AS INT) AS b1, CAST(round_even(f / 1.5e0, 0) AS INT) AS b2, 200 AS b3 FROM f""")
def receiver_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.receiver_budgets(read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("receiver"), (F.col("l_quantity") * 6).alias("cost"))))


_PARTNERS = f"""{ORDER_ATOMS}, near AS (SELECT a.document_id, a.atom_id AS focal_id, b.atom_id AS partner_id, abs(a.tokens - b.tokens) AS distance, a.role = b.role AS same_role
    FROM order_atoms a JOIN order_atoms b ON a.document_id = b.document_id AND a.atom_id <> b.atom_id AND abs(a.tokens - b.tokens) <= 5),
    best AS (SELECT *, row_number() OVER (PARTITION BY document_id, focal_id ORDER BY distance, same_role, partner_id) AS i FROM near)"""


@query(f"WITH {_PARTNERS} SELECT document_id, focal_id, partner_id, distance, same_role FROM best WHERE i = 1")
def eviction_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.eviction_partners(order_atoms(spark, sf_dir), 5)


_RETENTION = f"{_PARTNERS}, kept AS (SELECT t AS tolerance, count(*) FILTER (distance <= t) / (SELECT CAST(count(*) AS DOUBLE) FROM order_atoms) AS retention FROM best, (VALUES (0), (1), (2), (3), (5)) g(t) WHERE i = 1 GROUP BY t)"


@query(f"WITH {_RETENTION} SELECT tolerance, {r9('retention', 'retention')} FROM kept")
def candidate_retention_by_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.retention_by_tolerance(order_atoms(spark, sf_dir)))


@query(f"WITH {_RETENTION} SELECT min(tolerance) FILTER (retention >= 0.3) AS tolerance FROM kept")
def eviction_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.eviction_tolerance(calibration.retention_by_tolerance(order_atoms(spark, sf_dir)), 0.3)


@query("""WITH g AS (SELECT n, n * 12 * 2 AS projected_calls FROM (VALUES (50), (100), (150), (200)) t(n)), r AS (SELECT *, CASE WHEN projected_calls > 3000 THEN 'calls' END AS reason FROM g)
    SELECT n, projected_calls, reason, coalesce(n = (SELECT max(n) FROM r WHERE reason IS NULL), false) AS chosen FROM r""")
def experiment_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, calibration.SUBSET_GRID))).alias("n"))
    return calibration.subset_choice(grid, 12, 20_000, 0.85)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_atoms(spark, sf_dir).select("document_id", "atom_id", "transmitted", (F.col("discount") - F.col("tax")).alias("delta_budget"), F.col("tokens").alias("rendered_tokens"), F.lit(1.0).alias("value"))


@query(f"""WITH {ORDER_ATOMS} SELECT document_id, {r9("sum(CASE WHEN transmitted = 1 THEN discount - tax ELSE 0e0 END)", "g_obs")}, {r9("covar_pop(transmitted, discount - tax)", "cov_t_delta")}, count(*) AS n_candidates FROM order_atoms GROUP BY document_id""")
def targeting_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.targeting_covariance(_candidates(spark, sf_dir), ["document_id"]))


@query()
def knapsack_gstar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.targeting(_candidates(spark, sf_dir), 60)


@query(f"""WITH {ORDER_ATOMS} SELECT count(*) AS n_pairs, {r9("avg(abs(discount - tax))", "mean_abs_interaction")}, {r9("avg(abs(d_plus - r_minus))", "mean_abs_delta")},
    {r9("avg(abs(discount - tax)) / avg(abs(d_plus - r_minus))", "ratio")}, avg(abs(discount - tax)) / avg(abs(d_plus - r_minus)) <= 0.25 AS additivity_supported FROM order_atoms""")
def interaction_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = order_atoms(spark, sf_dir).select(F.col("discount").alias("with_partner"), F.col("tax").alias("without_partner"), (F.col("d_plus") - F.col("r_minus")).alias("delta"))
    return rounded(calibration.interaction_diagnostic(pairs))


@query(f"""WITH RECURSIVE {ORDER_ATOMS}, o AS (SELECT document_id, atom_id, tokens, row_number() OVER (PARTITION BY document_id ORDER BY {draw_sql("'9'", "document_id", "atom_id")}, atom_id) AS i FROM order_atoms),
    walk AS (SELECT document_id, 0 AS i, CAST(0 AS BIGINT) AS spent, CAST([] AS VARCHAR[]) AS ids FROM (SELECT DISTINCT document_id FROM o)
        UNION ALL SELECT w.document_id, CAST(o.i AS INT), CASE WHEN spent + tokens <= 60 THEN spent + tokens ELSE spent END, CASE WHEN spent + tokens <= 60 THEN list_append(ids, atom_id) ELSE ids END FROM walk w JOIN o ON o.document_id = w.document_id AND o.i = w.i + 1)
    SELECT document_id, spent, CAST(len(ids) AS INT) AS n_chosen, array_to_string(list_sort(ids), ',') AS chosen FROM walk QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY i DESC) = 1""")
def uniform_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.uniform_atoms(order_atoms(spark, sf_dir).select("document_id", "atom_id", F.col("tokens").alias("cost")), 60, 9)


_PROBES = f"{ORDER_ATOMS}, probes AS (SELECT document_id, sum(transmitted) AS s, count(*) AS m, avg(r_minus) AS r FROM order_atoms GROUP BY document_id), binned AS (SELECT *, s / CAST(m AS DOUBLE) AS p, CASE WHEN s / CAST(m AS DOUBLE) < 1 / 3e0 THEN 'low' WHEN s / CAST(m AS DOUBLE) < 2 / 3e0 THEN 'medium' ELSE 'high' END AS bin FROM probes)"


@query(f"WITH {_PROBES} SELECT document_id, CAST(s AS BIGINT) AS successes, m AS m_prior, {r9('p', 'p_hat')}, {r9('sqrt(greatest(p * (1 - p), 0e0) / m)', 'binomial_se')}, bin FROM binned")
def prior_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.prior_probes(order_atoms(spark, sf_dir).select("document_id", F.col("transmitted").alias("success")), ["document_id"]))


@query(f"""WITH {_PROBES}, g AS (SELECT b.bin, k, avg(r) AS mean, count(r) AS n FROM (VALUES ('low', 1), ('medium', 2), ('high', 3)) b(bin, k) LEFT JOIN binned USING (bin) GROUP BY ALL),
    f AS (SELECT *, coalesce(mean < lag(mean) OVER (ORDER BY k) - 1e-12, false) AS falls FROM g) SELECT bin, {r9("mean", "mean")}, n, NOT bool_or(falls) OVER () AS monotone_increasing FROM f""")
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = order_atoms(spark, sf_dir)
    probes = calibration.prior_probes(outcomes.select("document_id", F.col("transmitted").alias("success")), ["document_id"])
    means = outcomes.groupBy("document_id").agg(F.avg("r_minus").alias("r"))
    return rounded(calibration.dose_response(probes.join(means, "document_id"), "r"))


@query(f"WITH {ORDER_ATOMS} SELECT {r9('avg(CASE WHEN d_plus = r_minus THEN 1e0 ELSE 0e0 END)', 'agreement')}, count(*) AS n FROM order_atoms")
def order_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.order_invariance(order_atoms(spark, sf_dir), "d_plus", "r_minus"))


_REPEATS = "rep AS (SELECT l_suppkey AS input_id, l_orderkey * 10 + l_linenumber AS repeat, l_returnflag AS output, l_linestatus AS outcome, l_discount AS value FROM lineitem)"


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("input_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("repeat"), F.col("l_returnflag").alias("output"), F.col("l_linestatus").alias("outcome"), F.col("l_discount").alias("value"), "l_partkey")


@query(f"""WITH p AS (SELECT p AS prompt, count(*) AS m, count(DISTINCT o) AS k FROM (SELECT l_orderkey AS p, l_linestatus AS o FROM lineitem) GROUP BY p)
    SELECT count(*) AS n_prompts, m AS repeats, count(*) FILTER (k > 1) AS n_disagreeing, {r9("1 - count(*) FILTER (k > 1) / CAST(count(*) AS DOUBLE)", "exact_agreement_rate")}, CASE WHEN m < 2 THEN 'INVALID' WHEN count(*) FILTER (k > 1) = 0 THEN 'D' ELSE 'S' END AS regime FROM p GROUP BY m""")
def determinism_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prompt"), F.col("l_linestatus").alias("output"))
    return rounded(calibration.determinism_audit(lines, by_repeats=True))


@query(f"""WITH {_REPEATS}, p AS (SELECT count(*) AS m, count(DISTINCT outcome) AS k FROM rep GROUP BY input_id)
    SELECT count(*) AS n_inputs, min(m) AS n_repeats, count(*) FILTER (k > 1) AS inputs_with_disagreement, CASE WHEN count(*) < 100 OR min(m) < 10 THEN 'NOT_AUDITED' WHEN count(*) FILTER (k > 1) = 0 THEN 'D_CONFIRMED' ELSE 'S_CONFIRMED' END AS regime FROM p""")
def reproducibility_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.reproducibility_regime(_repeats(spark, sf_dir))


@query(f"""WITH {_REPEATS}, p AS (SELECT var_pop(value) AS v, avg(value) AS m FROM rep GROUP BY input_id), s AS (SELECT avg(v) AS a, coalesce(var_samp(m), 0e0) AS b FROM p)
    SELECT {r9("a", "sigma2_decode")}, {r9("b", "sigma2_document")}, {r9("a / b", "ratio")}, CASE WHEN a <= 0.1 * b THEN 1 WHEN a / 2 <= 0.1 * b THEN 2 WHEN a / 3 <= 0.1 * b THEN 3 ELSE 5 END AS m_star,
    a / 5 <= 0.1 * b AS criterion_met, NOT (a / 5 <= 0.1 * b) AS hierarchical_bootstrap_required FROM s""")
def replication_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.replication_rule(_repeats(spark, sf_dir)))


@query(f"""WITH {_REPEATS}, u AS (SELECT input_id, repeat, min(output) AS output, min(outcome) AS outcome FROM rep GROUP BY input_id, repeat), f AS (SELECT *, first_value(output) OVER (PARTITION BY input_id ORDER BY repeat) AS first, row_number() OVER (PARTITION BY input_id ORDER BY repeat) AS k FROM u),
    p AS (SELECT input_id, count(*) FILTER (k > 1 AND output = first) AS same, count(*) - 1 AS later, count(DISTINCT outcome) AS kinds FROM f GROUP BY input_id)
    SELECT {r9("sum(same) / nullif(sum(later), 0)", "byte_identity_rate")}, {r9("avg(CASE WHEN kinds = 1 THEN 1e0 ELSE 0e0 END)", "canonical_unanimity_rate")} FROM p""")
def repeat_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = _repeats(spark, sf_dir).groupBy("input_id", "repeat").agg(F.min("output").alias("output"), F.min("outcome").alias("outcome"))
    return rounded(calibration.repeat_identity(unique))


# Validation, registry, policy.


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    key = F.col("user_id").cast("string")
    return e.select(
        F.sha2(key, 256).alias("document_id_hash"), F.when(F.col("event_id") % 11 == 0, "train").otherwise("test").alias("split"), F.col("event_type").alias("policy_id"),
        F.when(F.col("event_id") % 13 == 0, "short").otherwise(F.sha2(key, 256)).alias("receiver_config_hash"), F.concat(F.lit("e"), F.col("event_id") % 5000).alias("logical_evaluation_id"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("raw_response_sha256"), F.concat(F.lit("m"), F.col("user_id") % 2).alias("metric_name"), F.col("value").alias("metric_value"),
        F.lit("EVALUABLE").alias("evaluable_status"), F.lit("EMPIRICAL").alias("evidence_stratum"), (F.col("event_id") % 9 - 1).cast("int").alias("realized_tokens"), F.lit(None).cast("int").alias("outer_fold"), "event_id",
    )


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 11 = 0 THEN 'split' END, CASE WHEN event_id % 13 = 0 THEN 'receiver_config_hash' END, CASE WHEN event_id % 9 = 0 THEN 'realized_tokens' END], lambda x: x IS NOT NULL), ',') AS violations FROM events""")
def outcome_lineage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.outcome_violations(_outcomes(spark, sf_dir)).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("""WITH g AS (SELECT event_type AS policy_id, concat('m', user_id % 2) AS metric_name, count(*) AS n, count(DISTINCT user_id) AS docs, count(DISTINCT event_id % 5000) AS evals, count(value) AS v, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL)
    SELECT policy_id, metric_name, n, array_to_string(list_filter([CASE WHEN docs <> n THEN 'duplicate_document' END, CASE WHEN n > 1 AND evals <> n THEN 'shared_evaluation' END, CASE WHEN v >= 10 AND lo = hi THEN 'invariant_values' END], lambda x: x IS NOT NULL), ',') AS violations FROM g""")
def batch_lineage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.batch_violations(_outcomes(spark, sf_dir)).withColumn("violations", F.array_join("violations", ","))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        F.col("s_name").alias("name"), F.element_at(F.array(*map(F.lit, ("PRIMARY_CAUSAL", "CONTROL", "ENDPOINT_ONLY", "PRIMARY_CAUSAL"))), (k % 4 + 1).cast("int")).alias("role"),
        F.when(k % 5 == 0, "PENDING").otherwise("READY").alias("status"), F.when(k % 7 == 0, None).otherwise(F.lit("r1")).alias("revision"), (k % 3 != 0).alias("produces_text"),
        F.col("s_acctbal").alias("native_reproduced_metric"), (F.col("s_acctbal") / 2000).alias("reproduction_deviation"), F.lit(2.0).alias("reproduction_tolerance"), F.lit("").alias("method_family"),
    )


@query("""WITH e AS (SELECT s_name AS name, s_suppkey AS k, s_acctbal, CASE s_suppkey % 4 WHEN 1 THEN 'CONTROL' WHEN 2 THEN 'ENDPOINT_ONLY' ELSE 'PRIMARY_CAUSAL' END AS role, s_suppkey % 5 = 0 AS pending FROM supplier),
    r AS (SELECT name, CASE WHEN role = 'CONTROL' AND pending THEN 'status' WHEN role = 'CONTROL' THEN 'control' WHEN role = 'ENDPOINT_ONLY' THEN 'endpoint_only' WHEN k % 7 = 0 THEN 'unresolved' WHEN pending THEN 'status'
        WHEN k % 3 = 0 THEN 'not_textual' WHEN abs(s_acctbal / 2000) > 2 THEN 'unreproduced' ELSE 'eligible' END AS reason FROM e) SELECT name, reason, reason IN ('control', 'eligible') AS eligible FROM r""")
def registry_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.registry_eligibility(_entries(spark, sf_dir)).select("name", "reason", "eligible")


@query("SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN concat('f', s_nationkey) ELSE s_name END AS family FROM supplier")
def family_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name"), F.concat(F.lit("f"), "s_nationkey").alias("family"))
    return validation.family_of(_entries(spark, sf_dir), declared).select("name", "family")


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN event_type NOT IN ('click', 'view') THEN 'provider' END, CASE WHEN event_id % 4 = 0 THEN 'browser_read_only' END, CASE WHEN event_id % 3 = 0 THEN 'protocol_freeze' END, CASE WHEN event_id % 2 = 0 THEN 'stage1_gate' END], lambda x: x IS NOT NULL), ',') AS reasons,
    NOT (event_type NOT IN ('click', 'view') OR event_id % 4 = 0 OR event_id % 3 = 0 OR event_id % 2 = 0) AS allow FROM events""")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    requests = read(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type").isin("click", "view"), "mock").otherwise(F.col("event_type")).alias("provider"), F.when(i % 4 == 0, "browser").otherwise("cli").alias("subject"), F.lit("run_experiment_c").alias("action"),
        F.lit("RESEARCH").alias("mode"), (i % 3 != 0).alias("protocol_freeze_present"), F.lit(True).alias("relay_model_pinned"), F.lit(True).alias("receiver_model_pinned"), (i % 2 != 0).alias("stage1_gate_passed"),
        F.lit(True).alias("calibration_parameters_resolved"), F.array().cast("array<string>").alias("unmet_freeze"),
    )
    return validation.policy_decision(requests).select("event_id", F.array_join("reasons", ",").alias("reasons"), "allow")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'ESTIMATED' WHEN o_orderstatus = 'O' THEN 'NOT_ESTIMATED' ELSE 'NOT_APPLICABLE' END AS state FROM orders""")
def typed_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("v"), (F.col("o_orderstatus") == "O").alias("possible"))
    return validation.typed_absence(rows, "v", "possible").select("o_orderkey", "state")


@query("""WITH f AS (SELECT DISTINCT event_type AS family, user_id % 3 AS m FROM events) SELECT family, concat('m', m) AS metric FROM f WHERE NOT (family = 'click' OR m = 0)""")
def metric_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "events").select(F.col("event_type").alias("family"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("metric")).distinct()
    allowed = pairs.where("family = 'click' OR metric = 'm0'")
    return validation.endpoint_violations(pairs, allowed)


# Logs.


@query(f"WITH {PROVIDER_CALLS} SELECT provider, status, count(*) AS n_calls, CAST(sum(greatest(0, input_tokens)) AS BIGINT) AS input_tokens, CAST(sum(greatest(0, output_tokens)) AS BIGINT) AS output_tokens, count(*) FILTER (attempt > 1) AS n_retries, {r9('sum(latency_s)', 'latency_s')} FROM calls GROUP BY ALL")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.ledger_summary(provider_calls(spark, sf_dir)))


@query(f"WITH {RUN_EVENTS} SELECT run_id, sequence, event_id FROM run_events WHERE sequence > 5")
def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.replay(run_events(spark, sf_dir), 5).select("run_id", "sequence", "event_id")


@query(f"""WITH {RUN_EVENTS}, k AS (SELECT * FROM run_events WHERE event_id % 50 <> 3), p AS (SELECT run_id, sequence, CAST(row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS INT) AS expected FROM k)
    SELECT run_id, sequence, expected FROM p WHERE expected <> sequence""")
def event_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.monotonic_violations(run_events(spark, sf_dir).where("event_id % 50 <> 3")).select("run_id", "sequence", "expected")


@query(f"""WITH {STAGED_EVENTS}, p AS (SELECT *, max(stage_at) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM staged WHERE started)
    SELECT run_id, sequence FROM p WHERE stage_at = 0 OR stage_at <= before""")
def event_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.topology_violations(staged_events(spark, sf_dir)).select("run_id", "sequence")


# Joins by order and overlap.

_DAY = 86_400_000_000


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS view_id, user_id, ts AS view_ts, value AS view_value FROM events WHERE event_type = 'view'),
    m AS (SELECT p.event_id, max({'t': view_ts, 'i': view_id, 'v': view_value}) AS b, min({'t': view_ts, 'i': -view_id}) FILTER (view_ts >= ts) AS a FROM p JOIN v ON p.user_id = v.user_id AND v.view_ts <= p.ts GROUP BY p.event_id),
    n AS (SELECT p.event_id, min({'t': view_ts, 'i': -view_id}) AS a FROM p JOIN v ON p.user_id = v.user_id AND v.view_ts >= p.ts AND v.view_ts <= p.ts + INTERVAL 2 DAY GROUP BY p.event_id)
    SELECT p.event_id, m.b.i AS view_before, round(m.b.v, 9) + 0e0 AS value_before, -n.a.i AS view_after FROM p LEFT JOIN m USING (event_id) LEFT JOIN n USING (event_id)""")
def views_around_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last view before it and the first after it within two days."""
    e = read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    views = e.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view_before"), F.col("value").alias("value_before"))
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    out = intervals.as_of(bought, views, ["user_id"], "at", ["view_before", "value_before"], 7 * _DAY)
    out = intervals.as_of(out, views.select("user_id", "at", F.col("view_before").alias("view_after")), ["user_id"], "at", ["view_after"], 7 * _DAY, tolerance=2 * _DAY, forward=True)
    return rounded(out.select("event_id", "view_before", "value_before", "view_after"))


_WINDOWS = "w AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS s, epoch_us(o_orderdate) + (10 + o_orderkey % 50) * 86400000000 AS e FROM orders)"


def _order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals of 10 to 59 days."""
    s = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", s.alias("s"), (s + (10 + F.col("o_orderkey") % 50) * F.lit(_DAY)).alias("e"))


@query(f"""WITH {_WINDOWS} SELECT a.o_custkey, a.o_orderkey AS first_order, b.o_orderkey AS second_order FROM w a JOIN w b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s < b.e AND b.s < a.e""")
def overlapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (_order_windows(spark, sf_dir).toDF("o_custkey", f"{k}_order", f"s{i}", f"e{i}") for i, k in enumerate(("first", "second")))
    return intervals.overlapping(first, second, ["o_custkey"], ("s0", "e0"), ("s1", "e1"), 30 * _DAY).where("first_order < second_order").select("o_custkey", "first_order", "second_order")


@query(f"""WITH RECURSIVE {_WINDOWS}, firsts AS (SELECT o_custkey, min({{'e': e, 's': s, 'k': o_orderkey}}) AS x FROM w GROUP BY o_custkey),
    pick AS (SELECT o_custkey, x FROM firsts UNION ALL SELECT p.o_custkey, (SELECT min({{'e': w.e, 's': w.s, 'k': w.o_orderkey}}) FROM w WHERE w.o_custkey = p.o_custkey AND w.s >= p.x.e) AS x FROM pick p WHERE p.x IS NOT NULL)
    SELECT o_custkey, x.k AS o_orderkey FROM pick WHERE x IS NOT NULL""")
def disjoint_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's order windows, taken by their ends, those that touch none taken before."""
    return intervals.greedy_disjoint(_order_windows(spark, sf_dir), ["o_custkey"], "s", "e", ["e", "s", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""WITH e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    c AS (SELECT user_id, ts AS start, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY i), ts + INTERVAL 1 DAY) AS until, i // 5 AS session FROM e WHERE i % 5 = 0), s AS (SELECT user_id, start, least(until, start + INTERVAL 3 DAY) AS until, session FROM c)
    SELECT e.event_id, max(s.session) AS session FROM e LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.start AND e.ts < s.until GROUP BY e.event_id""")
def events_in_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the interval of its user that holds it: from every fifth event to the next, three days at most."""
    from pyspark.sql import Window as W

    e = read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    numbered = e.withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    fifth = numbered.where("i % 5 = 0")
    until = F.coalesce(F.lead("at").over(W.partitionBy("user_id").orderBy("i")), F.col("at") + _DAY)
    sessions = fifth.select("user_id", F.col("at").alias("start"), F.least(until, F.col("at") + 3 * _DAY).alias("until"), F.floor(F.col("i") / 5).alias("session"))
    return intervals.covering(e.select("event_id", "user_id", "at"), sessions, ["user_id"], "at", "start", "until", ["session"], 7 * _DAY).select("event_id", "session")


# Learners.

_X = ("x_price", "x_tax", "x_tokens")
_ROWS = f"""rows AS (SELECT document_id, atom_id, price / 1e5 AS x0, tax AS x1, tokens / 50e0 AS x2, discount AS x3,
    CAST({draw_sql("'1'", "document_id")} % 5 AS INT) AS fold, CAST({draw_sql("'2'", "document_id")} % 4 AS INT) AS inner_fold FROM order_atoms)"""
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_MOMENTS = ["n", *(f"s{i}" for i in range(4)), *(f"p{i}{j}" for i, j in _PAIRS)]
_MOMENTS_SQL = ", ".join(["CAST(count(*) AS DOUBLE) AS n", *(f"sum(x{i}) AS s{i}" for i in range(4)), *(f"sum(x{i} * x{j}) AS p{i}{j}" for i, j in _PAIRS)])
_ADDED = ", ".join(f"sum({m}) AS {m}" for m in _MOMENTS)


def _det(m: list[list[str]]) -> str:
    a, b, c = m
    minor = lambda i, j: f"(({b[i]}) * ({c[j]}) - ({b[j]}) * ({c[i]}))"
    return f"(({a[0]}) * {minor(1, 2)} - ({a[1]}) * {minor(0, 2)} + ({a[2]}) * {minor(0, 1)})"


def _ridge_sql(source: str, keys: str) -> str:
    """SQL for b0, b1, b2 and b of each row of moments and penalty, by Cramer's rule on the centred normal equations."""
    centred = ", ".join(f"p{i}{j} - s{i} * s{j} / n AS c{i}{j}" for i, j in _PAIRS)
    c = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    left = [[c(i, j) + (" + penalty" if i == j else "") for j in range(3)] for i in range(3)]
    solved = ", ".join(f"{_det([[c(i, 3) if j == k else left[i][j] for j in range(3)] for i in range(3)])} / {_det(left)} AS b{k}" for k in range(3))
    return f"SELECT {keys}, penalty, b0, b1, b2, (s3 - b0 * s0 - b1 * s1 - b2 * s2) / n AS b FROM (SELECT *, {solved} FROM (SELECT *, {centred} FROM {source}, (SELECT unnest([0.1e0, 1e0, 10e0]) AS penalty)))"


_ERROR = "(p33 + b0 * b0 * p00 + b1 * b1 * p11 + b2 * b2 * p22 + 2 * (b0 * b1 * p01 + b0 * b2 * p02 + b1 * b2 * p12 - b0 * p03 - b1 * p13 - b2 * p23) - 2 * b * (s3 - b0 * s0 - b1 * s1 - b2 * s2) + n * b * b) / n"
_RIDGE = f"""WITH {ORDER_ATOMS}, {_ROWS}, parts AS (SELECT fold, {_MOMENTS_SQL} FROM rows GROUP BY fold), rest AS (SELECT a.fold, {", ".join(f"sum(b.{m}) AS {m}" for m in _MOMENTS)} FROM parts a JOIN parts b ON a.fold <> b.fold GROUP BY a.fold),
    solved AS ({_ridge_sql("rest", "fold")}), scores AS (SELECT penalty, avg({_ERROR}) AS cv_mse FROM solved JOIN parts USING (fold) GROUP BY penalty), best AS (SELECT * FROM scores ORDER BY cv_mse, penalty LIMIT 1),
    whole AS (SELECT {_ADDED} FROM parts), model AS (SELECT m.* FROM ({_ridge_sql("whole", "n")}) m JOIN best USING (penalty))"""
_PREDICTION = r9("b + b0 * x0 + b1 * x1 + b2 * x2", "prediction")


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_atoms(spark, sf_dir).select("document_id", "atom_id", (F.col("price") / 1e5).alias("x_price"), F.col("tax").alias("x_tax"), (F.col("tokens") / 50).alias("x_tokens"), F.col("discount").alias("target"))
    return rows.withColumn("fold", (draw(1, F.col("document_id")) % 5).cast("int"))


@query(f"{_RIDGE} SELECT document_id, atom_id, {_PREDICTION} FROM rows, model")
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _training(spark, sf_dir)
    return rounded(learning.predict(rows, learning.fit_ridge(rows, list(_X), "target")).select("document_id", "atom_id", "prediction"))


@query(f"{_RIDGE} SELECT 'Ridge' AS family, penalty AS alpha, {r9('cv_mse', 'cv_mse')}, (SELECT count(*) FROM rows) AS n_train_atoms, (SELECT count(DISTINCT document_id) FROM rows) AS n_train_documents FROM best")
def policy_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = learning.fit_policy(_training(spark, sf_dir), list(_X), "target")
    row = (m["family"], m["params"]["alpha"], m["cv_mse"], m["n_train_atoms"], m["n_train_documents"])
    return rounded(spark.createDataFrame([row], "family string, alpha double, cv_mse double, n_train_atoms long, n_train_documents long"))


def _chosen(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    m = learning.fit_policy(_training(spark, sf_dir), list(_X), "target", family)
    row = (m["family"], json.dumps(m["params"], sort_keys=True), m["cv_mse"], m["n_train_atoms"], m["n_train_documents"], len(m["estimator"].trees))
    return rounded(spark.createDataFrame([row], "family string, params string, cv_mse double, n_train_atoms long, n_train_documents long, n_trees int"))


@query()
def policy_fit_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary learner over its whole grid; tests hold the trees against plain growing."""
    return _chosen(spark, sf_dir, "HistGradientBoostingRegressor")


@query()
def policy_fit_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir, "ExtraTreesRegressor")


@query(f"""WITH {ORDER_ATOMS}, {_ROWS}, m AS (SELECT fold, x1, x2, x3 - avg(x3) OVER (PARTITION BY fold) AS g FROM rows), g AS (SELECT fold, 'x_tax' AS feature, x1 AS x, g FROM m UNION ALL SELECT fold, 'x_tokens', x2, g FROM m),
    h AS (SELECT fold, feature, x, sum(g) AS g, count(*) AS n FROM g GROUP BY fold, feature, x),
    c AS (SELECT *, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY fold, feature) AS gt, sum(n) OVER (PARTITION BY fold, feature) AS nt, (x + lead(x) OVER w) / 2 AS threshold FROM h WINDOW w AS (PARTITION BY fold, feature ORDER BY x)),
    s AS (SELECT fold, feature, threshold, nl, round(gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt, 9) AS gain FROM c WHERE nl >= 20 AND nt - nl >= 20)
    SELECT fold, feature, {r9("threshold", "threshold")}, CAST(nl AS BIGINT) AS n_left, {r9("gain", "gain")} FROM s WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, feature, threshold) = 1""")
def boosting_first_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of a boosted tree in every fold, over features with few values."""
    features = ["x_tax", "x_tokens"]
    rows = _training(spark, sf_dir)
    cuts = trees.thresholds(rows, features)
    means = rows.groupBy("fold").agg(F.avg("target").alias("mean"))
    bins = [trees.bin_column(F.col(x), c) for x, c in zip(features, cuts)]
    each = F.array(*(F.struct(F.lit(k).alias("feature"), b.alias("bin")) for k, b in enumerate(bins)))
    sums = rows.join(means, "fold").select("fold", (F.col("target") - F.col("mean")).alias("g"), F.explode(each).alias("_e")).groupBy("fold", "_e.feature", "_e.bin").agg(F.sum("g").alias("g"), F.count("*").alias("n"))
    best = trees.best_splits(sums, ["fold"], F.lit(20))
    at = F.element_at(F.element_at(F.array(*(F.array(*map(F.lit, c.tolist())) for c in cuts)), F.col("feature") + 1), F.col("bin") + 1)
    return rounded(best.select("fold", F.element_at(F.array(*map(F.lit, features)), F.col("feature") + 1).alias("feature"), at.alias("threshold"), F.col("nl").alias("n_left"), "gain"))


@query(f"""WITH {ORDER_ATOMS}, {_ROWS}, cells AS (SELECT fold, inner_fold, {_MOMENTS_SQL} FROM rows GROUP BY fold, inner_fold), folds AS (SELECT DISTINCT fold AS held FROM cells),
    rest AS (SELECT held, i AS inner_fold, {_ADDED} FROM folds, range(4) r(i), cells WHERE fold <> held AND inner_fold <> i GROUP BY held, i), tests AS (SELECT held, inner_fold, {_ADDED} FROM folds JOIN cells ON fold <> held GROUP BY held, inner_fold),
    solved AS ({_ridge_sql("rest", "held, inner_fold")}), scores AS (SELECT held, penalty, avg({_ERROR}) AS mse FROM solved JOIN tests USING (held, inner_fold) GROUP BY held, penalty),
    best AS (SELECT held, penalty FROM scores QUALIFY row_number() OVER (PARTITION BY held ORDER BY mse, penalty) = 1), trains AS (SELECT held, {_ADDED} FROM tests GROUP BY held),
    models AS (SELECT m.* FROM ({_ridge_sql("trains", "held")}) m JOIN best USING (held, penalty)) SELECT document_id, atom_id, {_PREDICTION} FROM rows JOIN models ON fold = held""")
def nested_crossfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _training(spark, sf_dir).withColumnRenamed("fold", "outer_fold").withColumn("inner_fold", (draw(2, F.col("document_id")) % 4).cast("int"))
    return rounded(learning.nested_crossfit(rows, list(_X), "target").select("document_id", "atom_id", "prediction"))


# Prior access, costs, lineage.

_PRIOR_ROLES = ("A", "N", "R", "X")


@query(f"""WITH {RECORDS}, used AS (SELECT *, 1e0 / pi AS w, d_plus - r_minus AS gap FROM records WHERE line % 2 = 1 AND tokens > 10), sums AS (SELECT document_id, role, sum(w * gap) AS a, sum(w) AS b FROM used GROUP BY document_id, role),
    {_taken_sql("sums", 13, inference.FINAL_REPLICATES)}, v AS (SELECT role, sum(times * a) / sum(times * b) AS v FROM taken GROUP BY role, replicate HAVING sum(times * b) > 0),
    ends AS (SELECT role, quantile_cont(v, 0.025) AS lower, quantile_cont(v, 0.975) AS upper FROM v GROUP BY role),
    points AS (SELECT role, count(*) AS n_slots, count(DISTINCT document_id) AS n_documents, avg(d_plus) AS r_natural, avg(r_minus) AS r_blocked, sum(w * gap) / sum(w) AS estimate, avg(gap) AS unweighted_mean FROM used GROUP BY role)
    SELECT role, coalesce(n_slots, 0) AS n_slots, coalesce(n_documents, 0) AS n_documents, {r9("r_natural", "r_natural")}, {r9("r_blocked", "r_blocked")}, {r9("estimate", "estimate")}, {r9("unweighted_mean", "unweighted_mean")},
    {r9("lower", "lower")}, {r9("upper", "upper")}, CASE WHEN n_slots IS NULL THEN 'NOT_ESTIMABLE' ELSE 'ESTIMABLE' END AS status, coalesce(estimate >= 0.1, false) AS clears_threshold
    FROM (SELECT unnest({list(_PRIOR_ROLES)}) AS role) LEFT JOIN points USING (role) LEFT JOIN ends USING (role)""")
def matched_prior_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = records(spark, sf_dir).select("document_id", "role", F.col("d_plus").alias("y_nat"), F.col("r_minus").alias("y_blk"), "pi", (F.col("line") % 2 == 1).alias("is_focal"), (F.col("tokens") > 10).alias("is_compliant"))
    return rounded(estimands.matched_prior_estimates(slots, list(_PRIOR_ROLES), seed=13))


@query(f"""WITH {PROVIDER_CALLS}, costed AS (SELECT provider, (greatest(0, input_tokens) * i + greatest(0, output_tokens) * o) / 1e6 AS cost FROM calls LEFT JOIN (VALUES ('click', 0.5e0, 1.5e0), ('view', 3e0, 15e0)) p(provider, i, o) USING (provider))
    SELECT provider, count(*) AS n_calls, {r9("coalesce(sum(cost), 0e0)", "spend_usd")}, count(*) FILTER (cost IS NULL) AS n_unpriced, CASE WHEN provider IS NULL THEN coalesce(sum(cost), 0e0) <= 1 END AS ceiling_respected FROM costed GROUP BY GROUPING SETS ((provider), ())""")
def cost_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 0.5, 1.5), ("view", 3.0, 15.0)], "provider string, input_usd double, output_usd double")
    return rounded(events.cost_ledger(events.call_costs(provider_calls(spark, sf_dir), prices), 1.0))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 7 = 0 THEN 'raw_response_sha256,cell_id' WHEN event_id % 3 = 0 THEN 'raw_response_sha256' ELSE 'cell_id' END AS violations FROM events
    WHERE event_type <> 'error' AND event_id % 5 <> 0 AND (event_id % 3 = 0 OR event_id % 7 = 0)""")
def untraced_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    results = read(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETE").alias("status"), F.when(i % 5 != 0, F.col("value")).alias("estimate"),
        F.when(i % 3 != 0, F.sha2(i.cast("string"), 256)).alias("raw_response_sha256"), F.when(i % 7 == 0, " ").otherwise(i.cast("string")).alias("cell_id"),
    )
    return validation.untraced_estimates(results).select("event_id", F.array_join("violations", ",").alias("violations"))
