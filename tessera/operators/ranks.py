"""Places in a total order over a whole table, without gathering it in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and the session runs on one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder, not yet made, that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of new_folder() that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a task in which whole documents meet.
TASK_ROWS = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by the keys, in as many tasks as so many rows need: a task does not grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // TASK_ROWS)), *keys)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_place(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's place from 0 in the order of the given columns.

    Rows are dealt out by range and sorted in their tasks; a row's place is its
    place there and the rows of the tasks before. Only the tasks' sizes, one
    row each, are gathered and broadcast.
    """
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    dealt.groupBy(task.alias("_task")).agg(F.count("*").alias("_n")).createOrReplaceTempView(view := f"tasks_{uuid.uuid4().hex}")
    before = df.sparkSession.sql(f"SELECT _task, sum(_n) OVER (ORDER BY _task) - _n AS _before FROM {view}")
    df.sparkSession.catalog.dropTempView(view)
    placed = dealt.withColumn("_task", task).join(F.broadcast(before), "_task")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_before", "_at")
