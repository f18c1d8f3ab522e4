"""The operators' queries over the tables of a directory, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, embed_dedup, fill_middle, langid, mixing, nearest, quality, sharding, simhash, substr_dedup, token_counts, toxicity, vector_codes
from .common import discard, new_folder, read

MIX = {"share": 0.8, "temper": 0.7, "rounds": 6, "seed": 11}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts; the digest cache starts empty in a folder of this run's own."""
    import public_tokenizers

    store = new_folder(spark, "token-cache")
    counted = token_counts.token_counts(
        read(spark, sf_dir, "documents"), store,
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )
    discard(spark, store)  # its counts are in a table of their own by now, and no later run reads this store
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read(spark, sf_dir, "documents"))


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(read(spark, sf_dir, "documents"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), **MIX, keep=["doc_id"])
    return mixed.select(
        "doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("cell_weight", 9).alias("cell_weight"), F.round("probability", 9).alias("probability"),
        F.round("residual", 9).alias("residual"), "sampled",
    )


def op5_sql() -> str:
    places = {x: f"i{i}" for i, x in enumerate(mixing.RANGES)}
    initials = ", ".join(f"len(regexp_extract_all(text, '{mixing.initials_pattern(p)}')) AS {places[x]}" for x, p in mixing.RANGES.items())
    named = ", ".join(f"coalesce({c}, '{mixing.NONE}') AS {c}" for c in ("source", "lang"))
    return f"""WITH texts AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
        counted AS (SELECT doc_id, {named}, greatest(len(regexp_extract_all(text, '{mixing.WORD}')), 1) AS tokens, {initials} FROM texts),
        placed AS (SELECT doc_id, source, lang, tokens, {mixing.topic_sql(places)} AS topic FROM counted),
        cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM placed GROUP BY ALL),
        weights AS ({mixing.rake_sql("cells", MIX["rounds"], MIX["temper"], {}, MIX["share"])})
        SELECT p.doc_id, p.topic, CAST(p.tokens AS BIGINT) AS n_tokens, round(w.cell_weight, 9) AS cell_weight, round(w.probability, 9) AS probability, round(w.residual, 9) AS residual,
            {mixing.draw_sql(MIX["seed"], "p.doc_id", "duckdb")} < w.probability AS sampled
        FROM placed p JOIN weights w USING (source, lang, topic)"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.linked_vectors(read(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr_dedup.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_vectors(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read(spark, sf_dir, "embeddings")).drop("label")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality, op3_language, op4_hilbert_shards, op5_mixture,
        op6_simhash, op7_decontamination, op8_toxicity, op9_embedding_links, op10_substring_dedup,
        op11_nearest_vectors, op12_vector_codes, op13_fill_middle,
    )
}

#: The others' results rest on hashes, models or indexes that DuckDB lacks; the tests hold them against brute force.
ORACLE_SQL = {"op5_mixture": op5_sql(), "op12_vector_codes": vector_codes.vector_codes_sql(), "op13_fill_middle": fill_middle.fill_in_middle_sql()}
