"""What the training-data operators share: shared folders, ranks, label joins.

Hashes used here are fixed functions of the value alone, so a task that is run
again after an executor is lost gives the same rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session sets none and runs on one machine (tests) is one
    made here; on a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = folder or tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of new_folder() that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, by an eager checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucket_of(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null for a null key."""
    return F.crc32(key.cast("string")) % F.lit(parts)


def set_apart(docs: DataFrame, used: set[str]) -> tuple[DataFrame, list[str]]:
    """docs with every column outside `used` renamed by its place, so that none clashes with an operator's own; and the new names.

    `.select(*names).toDF(*docs.columns)` turns it back.
    """
    names = [c if c in used else f"_column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def utf8(text: Column) -> Column:
    """The text's bytes; a null text has none."""
    return F.coalesce(text, F.lit("")).cast("binary")


def ranked(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """df with the 0-based place of each row in the given total order.

    Rows are dealt out by range, so equal leading keys do not meet in one task
    as long as the order ends in a near-unique column. The dealt-out rows are
    cut off before they are counted: a second range sampling could deal them
    out differently. The offsets table has one row for each partition.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    sizes.createOrReplaceTempView(view := f"sizes_{uuid.uuid4().hex}")
    offsets = df.sparkSession.sql(
        f"SELECT _part, sum(_rows) OVER (ORDER BY _part) - _rows AS _before FROM {view}"
    )
    df.sparkSession.catalog.dropTempView(view)
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    joined = dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(rank, place).drop("_part", "_before", "_at")


def texts_within(rows: DataFrame, keys: list[str], listed: list[Row], most_bytes: int) -> list[Row]:
    """(keys, _text) of the listed rows (keys, _hash, _size) on the driver, one of each; those that fit into most_bytes, in their order."""
    taken, left = [], most_bytes
    for r in listed:
        if r["_size"] <= left:
            left -= r["_size"]
            taken.append((*(r[k] for k in keys), r["_hash"]))
    if not taken:
        return []
    wanted = rows.sparkSession.createDataFrame(taken, rows.select(*keys, "_hash").schema)
    found = rows.join(F.broadcast(wanted), [*keys, "_hash"]).select(*keys, "_hash", "_text")  # as many rows as were listed, at most
    return found.dropDuplicates([*keys, "_hash"]).drop("_hash").collect()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, parts: int, most: int, most_bytes: int = 64 << 20) -> list[tuple[bytes, int]]:
    """At most `most` labelled texts outside the held-out fold, of at most most_bytes together, on the driver.

    Rows come in the order of a hash of doc_id, so the sample depends neither
    on the number of partitions nor on the order of the rows. Both bounds hold
    whatever the size of the tables and however often an id or a row repeats;
    a text that no longer fits is passed over. Null labels, null ids and rows
    of the fold are left out; of rows alike in id, text and label one counts.
    """
    kept = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where(
        F.col("_y").isin(0, 1) & (bucket_of(F.col("doc_id"), parts) != fold)
    )
    picked = kept.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(most)
    texts = docs.select("doc_id", utf8(F.col("text")).alias("_text"))
    rows = cut(texts.join(F.broadcast(picked), "doc_id").withColumns({"_hash": F.xxhash64("_text"), "_size": F.octet_length("_text")}))
    listed = rows.select("doc_id", "_y", "_hash", "_size").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_y", "_hash").limit(most).collect()
    found = sorted((r["doc_id"], bytes(r["_text"]), r["_y"]) for r in texts_within(rows, ["doc_id", "_y"], listed, most_bytes))
    return [(text, y) for _, text, y in found]
