"""Readers and writers of the file forms in use."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions import digests
from tessera.functions.text import has_secret, html_col, looks_like_html, source_frames
from tessera.operators.ranks import discard, new_folder, with_place

DOCUMENT = "document_id string, issuer_id string, fiscal_year int, text string, retrieved_utc string, source_url string, licence string"
INVENTORY = "document_id string, atom_id string, role string, canonical_value string, surface_form string, char_start int, char_end int, sentence_index int, occurrence_count int, verification string"
REVIEW = ("atom_id", "role", "canonical_value", "surface_form", "local_context", "decision")
AUDIT = ("item_id", "role", "canonical_value", "message", "human_present")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document for each file of a folder."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(folder)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, text): one document for each text file, named by it."""
    return spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("document_id"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same for HTML files, freed of their markup; files that are none are taken as they are."""
    raw = read_texts(spark, folder)
    return raw.select("document_id", F.when(looks_like_html(F.col("text")), html_col("text")).otherwise(F.col("text")).alias("text"))


#: Readers of documents by name: (session, folder) to a table with document_id and text. A caller may put in its own.
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"json": read_documents, "text": read_texts, "html": read_pages}


def write_source_pool(documents: DataFrame, folder: str, window: int, section: str = "full", required: bool = False) -> DataFrame:
    """Frames of documents as parquet under `frames`, and what they are as CSV under `manifest`; the manifest."""
    source_frames(documents, window, section, required).write.parquet(f"{folder}/frames")
    manifest = documents.sparkSession.read.parquet(f"{folder}/frames").drop("text")
    manifest.write.option("header", True).csv(f"{folder}/manifest")
    return manifest


def write_inventory(atoms: DataFrame, folder: str) -> None:
    names = [f.split(" ")[0] for f in INVENTORY.split(", ")]
    atoms.select(*names).write.option("header", True).csv(folder)


def read_inventory(spark: SparkSession, folder: str, accepted_only: bool = True) -> DataFrame:
    rows = spark.read.schema(INVENTORY).option("header", True).csv(folder)
    return rows.where("verification = 'accepted'") if accepted_only else rows


def write_review_sheet(atoms: DataFrame, folder: str) -> None:
    """Atoms for human decisions, which start out empty."""
    atoms.withColumn("decision", F.lit("")).select(*REVIEW).write.option("header", True).csv(folder)


def write_audit_sheet(items: DataFrame, folder: str) -> None:
    """Matcher items without the prediction, so that the audit is blind."""
    items.withColumn("human_present", F.lit("")).select(*AUDIT).write.option("header", True).csv(folder)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines without comments and blanks."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    return lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))


def registry_frame(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of a YAML registry by name; a small file, read on the driver from any store."""
    import yaml

    raw = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    body = (yaml.safe_load(bytes(raw).decode("utf-8")) or {}).get("baselines") or {}
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    rows = [tuple(name if c == "name" else entry.get(c) for c in names) for name, entry in sorted(body.items())]
    return spark.createDataFrame(rows, schema)


def append_ledger(calls: DataFrame, folder: str) -> None:
    """Calls appended as JSON lines; a secret in any of them stops the write."""
    line = F.to_json(F.struct(*calls.columns))
    guarded = calls.where(F.when(has_secret(line), F.raise_error(F.lit("a secret in the ledger")).cast("boolean")).otherwise(F.lit(True)))
    guarded.write.mode("append").json(folder)


def _line(outcomes: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(outcomes.columns)))


def outcome_digest(outcomes: DataFrame, order: list[str], lines: int = 10_000) -> DataFrame:
    """One row: the SHA-256 of the outcomes as JSON lines with sorted keys, in the given order.

    Up to `lines` rows it is that of the bytes themselves; more are cut into
    runs of so many lines, and it is that of the runs' digests, one after
    another, so that no task gathers more than one run or all runs' digests.
    """
    placed = with_place(outcomes.select(*order, F.concat(_line(outcomes), F.lit("\n")).alias("_line")), order, "_place")
    runs = placed.groupBy(F.floor(F.col("_place") / lines).alias("_run")).agg(F.sort_array(F.collect_list(F.struct("_place", "_line"))).alias("_lines"))
    digests = runs.select("_run", F.size("_lines").cast("long").alias("_n"), F.sha2(F.array_join(F.col("_lines._line"), ""), 256).alias("_h"))
    listed = digests.agg(F.sort_array(F.collect_list(F.struct("_run", "_h"))).alias("_all"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"))
    joined = F.array_join(F.col("_all._h"), "")
    return listed.select(F.when(F.size("_all") == 1, joined).otherwise(F.sha2(joined, 256)).alias("sha256"), "n_rows")


def write_outcomes(outcomes: DataFrame, folder: str, order: list[str], form: str = "jsonl") -> DataFrame:
    """Write outcomes as JSON lines with sorted keys or as CSV, in order across the parts; the parts' names, digests and sizes.

    Rows that break a rule of the batch (validation.outcome_violations) stop
    the write.
    """
    from tessera.operators.validation import outcome_violations

    if form not in ("jsonl", "csv"):
        raise ValueError(f"unknown form {form!r}")
    broken = outcome_violations(outcomes).where(F.size("violations") > 0)
    if not broken.isEmpty():
        raise ValueError(f"outcomes break the rules {sorted(broken.first()['violations'])}")
    ranged = outcomes.repartitionByRange(*order).sortWithinPartitions(*order)
    if form == "jsonl":
        ranged.select(_line(outcomes).alias("value")).write.text(folder)
    else:
        ranged.select(*sorted(outcomes.columns)).write.option("header", True).csv(folder)
    parts = file_manifest(outcomes.sparkSession, folder).where(F.col("path").rlike("/part-[^/]*$"))
    return parts.select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256", "bytes")


#: Marks of a field that is still open.
OPEN = ("", "UNFROZEN", "TBD", "PROPOSED")


def freeze_record(kind: str, fields: dict, required: list[str]) -> str:
    """A record of frozen settings as JSON with its own SHA-256; an open field is an error."""
    gaps = [f for f in required if fields.get(f) is None or fields[f] in OPEN]
    if gaps:
        raise ValueError(f"the {kind} record lacks {', '.join(gaps)}")
    body = {"fields": fields, "kind": kind}
    digest = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return json.dumps(body | {"record_sha256": digest}, indent=2, sort_keys=True) + "\n"


#: What a result must name to be traced: lists that are not empty, and the digest of its file.
TRACED = ("run_ids", "source_hashes", "config_hashes", "model_revisions")


def results_manifest(entries: DataFrame) -> DataFrame:
    """entries (artifact, kind, the lists of TRACED, artifact_sha256) with gaps, the parts of their lineage that are missing, and a digest of each."""
    from tessera.operators.validation import reasons

    gaps = reasons({c: F.size(c) > 0 for c in TRACED} | {"artifact_sha256": F.col("artifact_sha256").isNotNull()})
    body = F.to_json(F.struct(*sorted(entries.columns)), {"ignoreNullFields": "false"})
    return entries.select("*", gaps.alias("gaps"), F.sha2(body, 256).alias("entry_sha256"))


#: Bytes of a file that one task reads whole, of a longer one that a task takes on from where the one before it ended, and of a piece.
WHOLE_BYTES, STEP_BYTES, PIECE_BYTES = 1 << 27, 1 << 28, 1 << 18
#: Endings of names whose files Spark's reader of lines would unpack.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".passthrough")
#: What that reader leaves out at the beginning of a file.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of every file under a path."""
    return file_hashes(spark, path).select("path", "sha256", "bytes")


def file_hashes(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    """(path, sha256, bytes, modified) of every file under a path, or of those only that meet `since`, a condition on modificationTime.

    A file of more than WHOLE_BYTES is cut by Spark's reader of lines, which
    splits it, into pieces in the shared folder; they are hashed step by step,
    each step of a file in a task that takes on the state of the step before.
    Packed files, which that reader would unpack, are read whole, and so is
    every file where the state is not to be had; Spark then takes none of 2 GB.
    """
    load = lambda names="*": spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path).where(F.lit(True) if since is None else since)
    whole = lambda df: df.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    files, longer = load(), F.col("length") > WHOLE_BYTES
    # contents stay unread here: a row for each long file
    long = files.where(longer).select(F.col("_metadata.file_path").alias("file"), "path", F.col("length").alias("bytes"), F.unix_micros("modificationTime").alias("micros")).collect() if digests.available() else []
    if not long:
        return whole(files)
    out = whole(files.where(~longer))
    if any(r.path.endswith(PACKED) for r in long):
        out = out.unionByName(whole(load(f"*{{{','.join(PACKED)}}}").where(longer)))
    if plain := {r.file: r for r in long if not r.path.endswith(PACKED)}:
        hashed = _hashed_in_steps(spark, path, {f: r.bytes for f, r in plain.items()})
        rows = spark.createDataFrame([(r.path, hashed[f], r.bytes, r.micros) for f, r in plain.items()], "path string, sha256 string, bytes long, micros long")
        out = out.unionByName(rows.select("path", "sha256", "bytes", F.timestamp_micros("micros").alias("modified")))
    return out


def _hashed_in_steps(spark: SparkSession, path: str, sizes: dict[str, int]) -> dict[str, str]:
    """The SHA-256 of each of some long files; only one state for each file comes to the driver after a step."""
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    file = F.col("_metadata.file_path")
    lines = lines.where((F.col("_metadata.file_size") > WHOLE_BYTES) & ~F.coalesce(F.regexp_like(file, F.lit("(" + "|".join(p.replace(".", r"\.") for p in PACKED) + ")$")), F.lit(False)))
    given = lines.select(file.alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))

    def cut_up(batches):
        import pyarrow as pa

        number = 0  # pieces of a task are in order
        for batch in batches:
            files, starts = batch.column(0), batch.column(1)
            cuts = [0, batch.num_rows]
            if batch.num_rows and (files[0], starts[0]) != (files[-1], starts[-1]):  # lines of one block lie together
                keys = list(zip(files.to_pylist(), starts.to_pylist()))
                cuts[1:1] = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for a, b in zip(cuts, cuts[1:]):
                if a < b and (name := files[a].as_py()) in sizes:
                    text = b"\n".join([*batch.column(2).slice(a, b - a).to_pylist(), b""])
                    parts = [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
                    n, start = len(parts), starts[a].as_py()
                    columns = [pa.array([name] * n), pa.array([start] * n, pa.int64()), pa.array(range(number, number + n), pa.int64()), pa.array(map(len, parts), pa.int64()), pa.array(parts, pa.binary()), pa.array([start // STEP_BYTES] * n, pa.int64())]
                    number += n
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "at", "number", "n", "bytes", "step"])

    folder, schema = new_folder(spark, "pieces"), "file string, at long, number long, n long, bytes binary, step long"
    given.mapInArrow(cut_up, schema).write.option("compression", "none").partitionBy("step").parquet(folder)
    pieces = spark.read.schema(schema).parquet(folder)
    totals = dict(pieces.groupBy("file").agg(F.sum("n")).collect())
    states: dict[str, tuple[bytes, int]] = {}
    for name, size in sizes.items():
        # each line has its end put on, the last one too, which may have had none
        short = size - totals.get(name, 0)
        if short not in (0, -1, 3, 2):
            raise ValueError(f"{name} was read as {totals.get(name, 0)} bytes of {size}")
        mark = BYTE_ORDER_MARK if short > 0 else b""
        states[name] = (digests.fed(digests.begun(), mark), len(mark))

    def taken_on(before: dict[str, tuple[bytes, int]]):
        def run(batches):
            import pyarrow as pa

            now: dict[str, tuple[bytes, int]] = {}
            for batch in batches:
                for name, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                    state, done = now.get(name) or before[name]
                    data = part.as_py()[: sizes[name] - done]
                    now[name] = (digests.fed(state, data), done + len(data))
            yield pa.RecordBatch.from_arrays([pa.array(list(now), pa.string()), pa.array([s for s, _ in now.values()], pa.binary()), pa.array([d for _, d in now.values()], pa.int64())], names=["file", "state", "done"])

        return run

    for step in range(max(sizes.values()) // STEP_BYTES + 1):
        ordered = pieces.where(F.col("step") == step).repartition("file").sortWithinPartitions("file", "at", "number")
        states |= {r.file: (bytes(r.state), r.done) for r in ordered.select("file", "bytes").mapInArrow(taken_on(dict(states)), "file string, state binary, done long").collect()}
    discard(spark, folder)
    if wrong := [name for name, (_, done) in states.items() if done != sizes[name]]:
        raise ValueError(f"not hashed to their ends: {wrong}")
    return {name: digests.ended(state) for name, (state, _) in states.items()}


def manifest_differences(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state): missing, added or changed files."""
    a, b = recorded.select("path", F.col("sha256").alias("a")), found.select("path", F.col("sha256").alias("b"))
    both = a.join(b, "path", "full_outer")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")


def cached(tasks: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Tasks answered by the cache, and those that are not; an answer of another model is an error."""
    wrong = F.when(F.col("returned_model") != model, F.raise_error(F.concat(F.lit("cached under "), "returned_model")).cast("boolean")).otherwise(F.lit(True))
    hits = tasks.join(cache, "task_key").where(wrong)
    return hits, tasks.join(cache, "task_key", "left_anti")


def latex_rows(table: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """Rows of a table with the best cell of each column in bold; nulls are dashes.

    values: column to `max` or `min`. The first row by key wins among equals.
    """
    from pyspark.sql import Window as W

    whole = W.partitionBy(F.lit(1))
    out, cells = table, []
    for c, direction in values.items():
        best = (F.max(c) if direction == "max" else F.min(c)).over(whole)
        out = out.withColumn(f"_b_{c}", F.min(F.when(F.col(c) == best, F.col(key))).over(whole) == F.col(key))
    for c in values:
        shown = F.coalesce(F.format_number(c, 3), F.lit("---"))
        cells.append(F.when(F.coalesce(f"_b_{c}", F.lit(False)), F.concat(F.lit("\\textbf{"), shown, F.lit("}"))).otherwise(shown))
    escaped = F.regexp_replace(key, r"([&%$#_{}])", r"\\$1")
    return out.select(key, F.concat(F.concat_ws(" & ", escaped, *cells), F.lit(r" \\")).alias("row"))
