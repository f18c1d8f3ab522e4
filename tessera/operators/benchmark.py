"""Compressors as columns, their results, reproduction gates and figures' data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import head_tokens, token_count

from .prompts import mock_relay, relay_prompt
from .ranks import cut
from .validation import assert_not_test, reasons

#: The reproduction gate's steps before the metric, and its tolerance.
GATE_STEPS = ("official_repository_installed", "revision_pinned", "example_ran", "development_metric_computed")
TOLERANCE = 2.0


def config_hash(config: Column) -> Column:
    """SHA-256 of a map's JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config)))), 256)


def full_context(text: Column, budget: int) -> Column:
    return text


def head_truncation(text: Column, budget: int) -> Column:
    return F.rtrim(head_tokens(text, budget))


def vanilla_relay(text: Column, budget: int, provider: Callable[[Column], Column] = mock_relay) -> Column:
    """What a relay answers to its task, source and budget; cut where it is over."""
    return F.rtrim(head_tokens(provider(relay_prompt(text, budget)), budget))


COMPRESSORS: dict[str, Callable[[Column, int], Column]] = {"full_context": full_context, "head_truncation": head_truncation, "vanilla_relay": vanilla_relay}


def register(name: str, compressor: Callable[[Column, int], Column]) -> None:
    """Add a compressor under a name that is free."""
    if name in COMPRESSORS:
        raise ValueError(f"there is a compressor {name!r}")
    COMPRESSORS[name] = compressor


def handoffs(frames: DataFrame, budget: int, methods: tuple[str, ...] = ("full_context", "head_truncation")) -> DataFrame:
    """One row for each frame and method, in one pass over the frames, with token counts and whether the budget holds.

    Only the full context may pass its budget; another method that does is an error.
    """
    rows = F.array(*(F.struct(F.lit(m).alias("method"), COMPRESSORS[m](F.col("text"), budget).alias("out")) for m in methods))
    out = frames.select("document_id", F.col("text").alias("_source"), F.explode(rows).alias("r"))
    out = out.select("document_id", "r.method", F.col("r.out").alias("text"), token_count(F.col("_source")).alias("input_tokens"), token_count(F.col("r.out")).alias("output_tokens"), F.lit(budget).alias("budget"))
    within = F.col("output_tokens") <= budget
    over = F.raise_error(F.concat(F.col("method"), F.lit(" is over its budget"))).cast("boolean")
    return out.withColumn("within_budget", F.when((F.col("method") != "full_context") & ~within, over).otherwise(within))


def timed_handoffs(frames: DataFrame, budget: int, methods: tuple[str, ...] = ("full_context", "head_truncation")) -> DataFrame:
    """(method, n_documents, input_tokens, output_tokens, over_budget, seconds): a pass over the frames for each method, measured apart.

    Counts are observed as the rows go by, and the rows go nowhere. seconds
    are of the whole pass, so that methods compare by what a corpus costs;
    reading the frames, which is the same for all, is in them.
    """
    import time

    from pyspark.sql import Observation

    rows = []
    for method in methods:
        seen = Observation()
        done = handoffs(frames, budget, (method,))
        watched = done.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("i"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("o"), F.count_if(~F.col("within_budget")).alias("over"))
        began = time.perf_counter()
        watched.write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        rows.append((method, seen.get["n"], seen.get["i"], seen.get["o"], seen.get["over"], took))
    return frames.sparkSession.createDataFrame(rows, "method string, n_documents long, input_tokens long, output_tokens long, over_budget long, seconds double")


def reproduction_verdicts(runs: DataFrame) -> DataFrame:
    """runs with their deviation, failed steps and verdict.

    Columns: method, split, steps (map to boolean), observed, expected,
    interval_low, interval_high. An interval, where given, decides instead of
    the tolerance. A run on a test split is an error.
    """
    for r in runs.select("split").distinct().limit(100).collect():
        assert_not_test(r["split"])
    deviation = F.col("observed") - F.col("expected")
    inside = (F.col("observed") >= F.col("interval_low")) & (F.col("observed") <= F.col("interval_high"))
    metric = F.when(deviation.isNull(), False).when(F.col("interval_low").isNotNull(), inside).otherwise(F.abs(deviation) <= TOLERANCE)
    checks = {s: F.element_at("steps", s) for s in GATE_STEPS} | {"native_metric_reproduced": metric}
    out = runs.withColumns({"deviation": deviation, "failed_steps": reasons(checks)})
    return out.withColumn("status", F.when(F.size("failed_steps") == 0, "READY").otherwise("UNREPRODUCED"))


def name_collisions(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, registered) pairs alike in their letters and digits."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    left = names.select("name", key("name").alias("_k"))
    right = registry.select(F.col("name").alias("registered"), key("name").alias("_k"))
    return left.join(right, "_k").where("_k <> ''").drop("_k")


def bar_data(decomposition: DataFrame, label: str) -> DataFrame:
    """(label, part, bottom, height) of stacked bars; an empty result is an error for whoever draws it."""
    parts = F.array(
        F.struct(F.lit("reconstruction").alias("part"), F.lit(0.0).alias("bottom"), F.col("r_bar_zero").alias("height")),
        F.struct(F.lit("volume").alias("part"), F.col("r_bar_zero").alias("bottom"), F.col("volume").alias("height")),
        F.struct(F.lit("alignment").alias("part"), (F.col("r_bar_zero") + F.col("volume")).alias("bottom"), F.col("alignment").alias("height")),
    )
    return decomposition.select(F.col(label).alias("label"), F.explode(parts).alias("p")).select("label", "p.*")


def common_documents(rows: DataFrame, by: str) -> DataFrame:
    """Documents that every value of `by` has."""
    k = rows.select(by).distinct().count()
    return rows.groupBy("document_id").agg(F.count_distinct(by).alias("_k")).where(F.col("_k") == k).select("document_id")


def status_accounting(leaves: DataFrame) -> DataFrame:
    """How many leaves of a protocol stand at each status; those without one are UNDECLARED."""
    return leaves.groupBy(F.coalesce("status", F.lit("UNDECLARED")).alias("status")).agg(F.count("*").alias("n"))


def protocol_leaves(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, status, value) of the leaves of each JSON document: a mapping with a status, or any other value.

    A list of plain values is one value, and plain values among nested ones are
    no leaves of their own. value is JSON, null for a leaf with a status. A
    null text has no leaves, an empty mapping none either; bad JSON is an error.
    Documents are walked as variants, one level of all of them at a time.
    """
    container = "^(OBJECT|ARRAY)<"
    todo = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.lit("").alias("path"), F.parse_json(F.col(text)).alias("_v"))
    found = None
    while True:
        kind = F.schema_of_variant("_v")
        elements = F.when(F.startswith(kind, F.lit("ARRAY<")), F.col("_v").cast("array<variant>"))
        nested = F.coalesce(F.exists(elements, lambda x: F.schema_of_variant(x).rlike(container)), F.lit(False))
        status = F.when(F.startswith(kind, F.lit("OBJECT<")), F.try_variant_get("_v", "$.status", "variant"))
        listed = F.concat(F.lit("["), F.array_join(F.transform(elements, lambda x: F.to_json(x)), ", "), F.lit("]"))
        named = F.when(F.is_variant_null(status), "none").otherwise(F.lower(F.trim(F.coalesce(F.try_variant_get("_v", "$.status", "string"), F.to_json(status)))))
        todo = cut(todo.select("*", kind.alias("_kind"), nested.alias("_nested"), F.when(status.isNotNull(), named).alias("status"), F.when(kind.rlike(container), listed).otherwise(F.to_json(F.col("_v"))).alias("value")))
        leaf = F.col("status").isNotNull() | ~(F.startswith("_kind", F.lit("OBJECT<")) | F.col("_nested"))
        leaves = todo.where(leaf).select(F.col("_key").alias(key), "path", "status", F.when(F.col("status").isNull(), F.col("value")).alias("value"))
        found = leaves if found is None else found.unionByName(leaves)
        inner = todo.where(~leaf)
        if inner.isEmpty():
            return found
        inner.createOrReplaceTempView(view := f"walk_{uuid.uuid4().hex}")
        inside = documents.sparkSession.sql(f"SELECT t._key, t.path, t._kind, e.pos, e.key, e.value FROM {view} t, LATERAL variant_explode(t._v) e")
        documents.sparkSession.catalog.dropTempView(view)
        listed_in = F.startswith("_kind", F.lit("ARRAY<"))
        inside = inside.where(~listed_in | F.schema_of_variant("value").rlike(container))
        step = F.when(listed_in, F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), F.col("key")))
        todo = inside.select("_key", step.alias("path"), F.col("value").alias("_v"))
