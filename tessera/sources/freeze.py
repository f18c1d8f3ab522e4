"""Freeze records read again and held against the files they name.

A frozen folder is kept as a tree of digests: of each file its SHA-256, length
and time, of each folder the digest of its files' and folders' digests, without
their names. Two folders of equal content have equal digests, and a change is
found by going down from the root. Files that are no newer than the freeze and
as long as they were keep their recorded digest unread.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import OPEN, file_hashes

TREE = "path string, is_file boolean, sha256 string, bytes long, modified timestamp"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def _relative(folder: str) -> Column:
    """The path below the folder, whatever scheme and authority the reader puts in front."""
    inner = folder.split("://", 1)[-1].removeprefix("file:").strip("/")
    return F.element_at(F.split(F.col("path"), F.lit(f"/{inner}/".replace("+", r"\+").replace(".", r"\."))), -1)


def file_digests(spark: SparkSession, folder: str, recorded: DataFrame | None = None, thorough: bool = True) -> DataFrame:
    """(path, is_file, sha256, bytes, modified) of every file below a folder.

    With a recorded tree and thorough=False only files newer than all it holds
    are read; of the others the digest is the recorded one where time and
    length are, and null (unknown) where they are not.
    """
    files = _files(spark, folder)
    names = [_relative(folder).alias("path"), F.lit(True).alias("is_file")]
    whole = lambda since=None: file_hashes(spark, folder, since).select(*names, "sha256", "bytes", "modified")
    if recorded is None or thorough:
        return whole()
    latest = recorded.where("is_file").agg(F.max("modified")).first()[0]
    if latest is None:
        return whole()
    # both filters reach the scan, so the contents of the older files stay unread
    newer, older = whole(F.col("modificationTime") > latest), files.where(F.col("modificationTime") <= latest)
    listed = older.select(*names, F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    known = recorded.where("is_file").select("path", "bytes", "modified", "sha256")
    return newer.unionByName(listed.join(known, ["path", "bytes", "modified"], "left").select(*newer.columns))


def digest_tree(files: DataFrame) -> DataFrame:
    """The files with every folder above them, up to the root (path ""), each level from the one below.

    A folder's children are put together in 4096 parts by their digests, so
    that no task gathers a folder of very many files.
    """
    levels = files.select(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    one = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    tree, below = files, None
    for level in range(levels - 1, -1, -1):
        here = files.where(F.size(F.split("path", "/")) == level + 1)
        children = here if below is None else here.unionByName(below)
        parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
        keyed = children.select(parent.alias("path"), F.coalesce("sha256", F.lit("unknown")).alias("sha256"), "bytes", "modified")
        parts = keyed.groupBy("path", F.substring("sha256", 1, 3).alias("_part")).agg(one("sha256").alias("sha256"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified"))
        below = parts.groupBy("path").agg(one("sha256").alias("sha256"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified")).select("path", F.lit(False).alias("is_file"), "sha256", "bytes", "modified")
        tree = tree.unionByName(below)
    return tree


def tree_differences(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, is_file, state) of what is missing, added, changed or, for a file that was not read, unknown."""
    a = recorded.select("path", "is_file", F.col("sha256").alias("a"), F.col("bytes").alias("n"))
    b = found.select("path", "is_file", F.lit(True).alias("there"), F.col("sha256").alias("b"), F.col("bytes").alias("m"))
    both = a.join(b, ["path", "is_file"], "full_outer")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("a").isNull(), "added").when((F.col("n") != F.col("m")) | (F.col("a") != F.col("b")), "changed").when(F.col("b").isNull(), "unknown")
    return both.select("path", "is_file", state.alias("state")).where("state IS NOT NULL")


def load_record(spark: SparkSession, path: str) -> dict:
    """A record of tables.freeze_record from any store; one whose digest is not its own is an error."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()
    if raw is None:
        raise ValueError(f"no record at {path}")
    try:
        record = json.loads(bytes(raw["content"]).decode("utf-8"))
        body = {"fields": record["fields"], "kind": record["kind"]}
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"unreadable freeze record {path}: {e}") from e
    digest = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    if record.get("record_sha256") != digest:
        raise ValueError(f"the record {path} has been edited since it was frozen")
    return record


def record_problems(record: dict, required: Iterable[str], referenced: DataFrame, found: DataFrame) -> DataFrame:
    """(item, problem) of a loaded record: open fields, and referenced artefacts that it does not carry, that are missing or that have changed.

    referenced: (field, path); found: digests of the files there are, as of
    file_digests. An untroubled record has no row.
    """
    spark = referenced.sparkSession
    gaps = [(f, "unfilled field") for f in required if record["fields"].get(f) is None or record["fields"][f] in OPEN]
    carried = spark.createDataFrame([(k, str(v)) for k, v in record["fields"].items()], "field string, expected string")
    joined = referenced.select("field", "path").join(carried, "field", "left").join(found.where("is_file").select("path", "sha256", F.lit(True).alias("there")), "path", "left")
    problem = F.when(F.col("expected").isNull(), "not in the record").when(F.col("there").isNull(), "missing").when(F.col("sha256") != F.col("expected"), "changed").when(F.col("sha256").isNull(), "unknown")
    broken = joined.select(F.col("field").alias("item"), problem.alias("problem")).where("problem IS NOT NULL")
    return spark.createDataFrame(gaps, "item string, problem string").unionByName(broken)
