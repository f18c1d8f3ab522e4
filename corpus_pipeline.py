"""From raw documents to shards: STAGES in order, each on what the one before kept.

Every stage but the last returns the columns of its documents, also where their
names are those an operator uses inside.

Nulls and odd input: a null text is read as an empty one by every stage; it is
scored, deduplicated with the empty texts (the least doc_id of them stays),
has no benchmark word, has mass 1 in the draw, and is kept unless one of these
says otherwise. Rows with a null doc_id are kept by the deduplication, one by
one, and dealt into shards. Ties between copies fall to the least doc_id; rows
that repeat in id and text count as one from the deduplication on. A null
language or source is a value of its own. With no labels nothing is rejected
as toxic, with no benchmark nothing as contaminated, and no documents give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, mixing, sharding, simhash, toxicity
from tessera.llm.common import discard, new_folder, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents scored below the limit by a model of the labels' documents."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near copies."""
    return simhash.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth is benchmark text."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn so that sources, languages and topics meet their target weights."""
    return mixing.sampled_documents(docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and slot along the Hilbert curve."""
    return sharding.hilbert_shards(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", one_of_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", draw_mixture),
    ("sharding", deal_into_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; every stage before it is written to the shared folder and read again.

    A folder is deleted once the next is written; the last one stays, for the
    result is read from it.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints and a trained classifier have no SQL; the stages' operators are held against brute force in the tests.
ORACLE_SQL = None
