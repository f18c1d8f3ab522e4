"""The driver's tables as this library's: records, disclosures, events, probes.

Each adapter has its SQL beside it, for the queries' SQL to start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.design import stratum_sizes
from tessera.operators.ranks import dealt


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of an order as an atom of a document, with costs and outcomes."""
    line = read(spark, sf_dir, "lineitem")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return line.select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("atom_id"),
        F.col("l_returnflag").alias("role"), F.col("l_quantity").cast("int").alias("tokens"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("transmitted"),
        one(F.col("l_discount") >= 0.03).alias("d_plus"), one(F.col("l_tax") >= 0.05).alias("r_minus"),
        F.when(F.col("l_quantity") <= 10, 0.5).otherwise(1.0).alias("q"), (F.col("l_linenumber") % 3).alias("hop"),
        F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )


ORDER_ATOMS = """order_atoms AS (SELECT CAST(l_orderkey AS VARCHAR) AS document_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS atom_id,
    l_returnflag AS role, CAST(l_quantity AS INT) AS tokens, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS transmitted,
    CASE WHEN l_discount >= 0.03 THEN 1e0 ELSE 0e0 END AS d_plus, CASE WHEN l_tax >= 0.05 THEN 1e0 ELSE 0e0 END AS r_minus,
    CASE WHEN l_quantity <= 10 THEN 0.5e0 ELSE 1e0 END AS q, l_linenumber % 3 AS hop, l_linenumber AS line,
    l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as causal records: one focal role drawn from each order's roles."""
    sized = stratum_sizes(dealt(order_atoms(spark, sf_dir), read(spark, sf_dir, "lineitem").count(), "document_id"))
    return sized.withColumn("pi", 1.0 / F.col("populated_strata") * (1.0 / F.col("stratum_size")))


RECORDS = ORDER_ATOMS + """, records AS (SELECT *, (1e0 / populated_strata) * (1e0 / stratum_size) AS pi FROM (
    SELECT *, count(*) OVER (PARTITION BY document_id, role) AS stratum_size,
    count(DISTINCT role) OVER (PARTITION BY document_id) AS populated_strata FROM order_atoms))"""

#: Region to the scope label it stands for.
SCOPES = {"AMERICA": "North America", "ASIA": "Asia Pacific", "EUROPE": "Europe", "AFRICA": "EMEA", "MIDDLE EAST": "EMEA"}


def scope_sql(region: str) -> str:
    return f"CASE {region} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SCOPES.items()) + " END"


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, text): a disclosure composed for each order from its customer and lines."""
    line, orders, customer, nation, region = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    where = customer.join(F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey)), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.expr(scope_sql("r_name")).alias("scope"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # both sides are dealt by the order, as columns: what is composed of them is moved no more. What follows is work
    # of Python on small rows: a fixed number of tasks is not merged for its few bytes
    head = orders.join(where, orders.o_custkey == where.c_custkey).select("o_orderkey", "o_custkey", "scope", F.year("o_orderdate").alias("year")).repartition(tasks, "o_orderkey")
    line = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate").repartition(tasks, "l_orderkey")
    said = F.concat(
        F.lit(" segment margin improved by "), F.round(F.col("l_discount") * 100).cast("int"), F.lit("%. Charges were $"), F.format_number("l_extendedprice", 2),
        F.lit(" million in Q"), F.quarter("l_shipdate"), F.lit(" FY"), F.year("l_shipdate"), F.lit(". See Note "), F.col("l_linenumber"), F.lit(" to the statements."),
    )
    lines = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", said.alias("said")))).alias("lines"))
    joined = head.join(lines, head.o_orderkey == lines.l_orderkey)
    opening = F.concat(F.lit("Cust"), "o_custkey", F.lit(" Holdings reported results for FY"), "year", F.lit("."))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.col("scope"), x["said"])), " ")
    return joined.select(F.col("o_orderkey").cast("string").alias("document_id"), F.concat_ws(" ", opening, body).alias("text"))


DISCLOSURES = f"""disclosures AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id,
    concat('Cust', any_value(o_custkey), ' Holdings reported results for FY', any_value(year(o_orderdate)), '. ',
    string_agg(concat({scope_sql("r_name")}, ' segment margin improved by ', CAST(round(l_discount * 100) AS INT), '%. Charges were $', format('{{:,.2f}}', l_extendedprice),
    ' million in Q', quarter(l_shipdate), ' FY', year(l_shipdate), '. See Note ', l_linenumber, ' to the statements.'), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS text
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""

#: The facts of the disclosures, straight from the columns they were composed of.
COMPOSED = f"""said AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id, o_custkey, year(o_orderdate) AS reported, {scope_sql("r_name")} AS scope,
    CAST(round(l_discount * 100) AS INT) AS pct, l_extendedprice AS price, quarter(l_shipdate) AS q, year(l_shipdate) AS y, l_linenumber AS note
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN lineitem ON l_orderkey = o_orderkey),
    facts AS (SELECT DISTINCT document_id, 'entity' AS role, concat('Cust', o_custkey, ' Holdings') AS canonical_value, 1 AS n, concat('Cust', o_custkey, ' Holdings') AS surface FROM said
    UNION ALL SELECT document_id, 'period', concat('FY', any_value(reported)), 1, concat('FY', any_value(reported)) FROM said GROUP BY document_id
    UNION ALL SELECT document_id, 'scope', scope, count(*), scope FROM said GROUP BY document_id, scope
    UNION ALL SELECT document_id, 'numeric', concat(pct, '%'), count(*), concat(pct, '%') FROM said GROUP BY document_id, pct
    UNION ALL SELECT document_id, 'numeric', concat('$', rtrim(rtrim(format('{{:.2f}}', price), '0'), '.'), '|million'), count(*), concat('$', format('{{:,.2f}}', price), ' million') FROM said GROUP BY document_id, price
    UNION ALL SELECT document_id, 'period', concat('FY', y, 'Q', q), count(*), concat('Q', q, ' FY', y) FROM said GROUP BY document_id, y, q
    UNION ALL SELECT document_id, 'provenance', concat('Note ', note), count(*), concat('Note ', note) FROM said GROUP BY document_id, note)"""

#: The same with their identifiers, and where each is first said: after `lead`, which tells it from longer ones.
SURFACES = f"""{DISCLOSURES}, {COMPOSED}, led AS (SELECT *, CASE WHEN role = 'numeric' AND surface LIKE '%\\%' ESCAPE '\\' THEN ' by ' WHEN role = 'period' AND surface LIKE 'FY%' THEN ' for ' ELSE '' END AS lead,
    concat(document_id, ':', role, ':', left(trim(regexp_replace(lower(canonical_value), '[^a-z0-9]+', '-', 'g'), '-'), 48)) AS atom_id FROM facts),
    surfaced AS (SELECT led.*, text, CAST(instr(text, concat(lead, surface)) + length(lead) - 1 AS INT) AS char_start FROM led JOIN disclosures USING (document_id))"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: a run for each user, numbered in the order of event_id."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), place.cast("long").alias("sequence"), "event_id", "event_type", "value")


RUN_EVENTS = "run_events AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, event_id, event_type, value FROM events)"


def staged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with stages: one starts at every sixth event, and planted starts repeat one, go back or are of no known stage."""
    from tessera.streaming.events import STAGES, STARTED

    sixth, i = (F.col("sequence") - 1) % 6 == 0, F.col("event_id")
    started = sixth | (i % 11 == 0)
    at = F.when(started & (i % 29 == 0), 0).otherwise(F.least(F.lit(13), F.floor((F.col("sequence") - 1) / 6) + 1) - F.when(sixth & (i % 17 == 0), 1).otherwise(0))
    at = F.greatest(at, F.lit(0)).cast("int")
    stage = F.when(at > 0, F.element_at(F.array(*map(F.lit, STAGES)), F.greatest(at, F.lit(1)))).otherwise("none")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sequence") * 60)
    return run_events(spark, sf_dir).select("run_id", "sequence", "event_id", F.when(started, STARTED).otherwise("stage.progress").alias("event_type"), stage.alias("stage"), ts.alias("ts"))


STAGED_EVENTS = f"""{RUN_EVENTS}, marked AS (SELECT *, (sequence - 1) % 6 = 0 AS sixth, (sequence - 1) % 6 = 0 OR event_id % 11 = 0 AS started FROM run_events),
    staged AS (SELECT *, greatest(0, CASE WHEN started AND event_id % 29 = 0 THEN 0 ELSE least(13, (sequence - 1) // 6 + 1) - CASE WHEN sixth AND event_id % 17 = 0 THEN 1 ELSE 0 END END) AS stage_at FROM marked)"""


def provider_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: the type is the provider, tokens of -1 are unknown."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_type").alias("provider"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("ok").alias("status"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt"),
        F.when(k % 10 == 0, -1).otherwise(k).alias("input_tokens"), F.when(k % 15 == 0, -1).otherwise(2 * k).alias("output_tokens"), F.col("value").alias("latency_s"),
    )


PROVIDER_CALLS = """calls AS (SELECT event_type AS provider, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, CAST(event_id % 3 + 1 AS INT) AS attempt,
    CASE WHEN k % 10 = 0 THEN -1 ELSE k END AS input_tokens, CASE WHEN k % 15 = 0 THEN -1 ELSE 2 * k END AS output_tokens, value AS latency_s
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
