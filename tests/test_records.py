"""Records, manifests, registries, learners and guards; and queries without SQL against brute force on their own tables."""

from __future__ import annotations

import gzip
import hashlib
import json
import random
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import matching as M, text as T
from tessera.operators import benchmark, design, learning
from tessera.plans import adapters, catalog
from tessera.sources import tables
from tessera.streaming import events
from tests.test_oracle import DATA


def test_manifest_is_of_every_file(spark):
    got = {r.file: (r.sha256, r.bytes) for r in catalog.queries()["manifest_hash"](spark, DATA).collect()}
    want = {p.name: (hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_size) for p in Path(DATA).iterdir()}
    assert got == want


@pytest.fixture(scope="module")
def outcomes(spark):
    h = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(250).select(
        h.alias("document_id_hash"), F.lit("test").alias("split"), F.lit("p").alias("policy_id"), h.alias("receiver_config_hash"), F.concat(F.lit("e"), "id").alias("logical_evaluation_id"),
        h.alias("raw_response_sha256"), F.lit("m").alias("metric_name"), (F.col("id") / 7).alias("metric_value"), F.lit("EVALUABLE").alias("evaluable_status"),
        F.lit("EMPIRICAL").alias("evidence_stratum"), F.lit(5).alias("realized_tokens"), F.lit(None).cast("int").alias("outer_fold"), "id",
    )


def test_outcomes_are_written_in_order_with_their_digests(spark, outcomes, tmp_path):
    parts = {r.file: r.sha256 for r in tables.write_outcomes(outcomes.repartition(5), str(tmp_path / "j"), ["id"]).collect()}
    files = sorted((tmp_path / "j").glob("part-*"))
    assert parts == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in files}
    content = b"".join(p.read_bytes() for p in files)
    ids = [json.loads(x)["id"] for x in content.decode().splitlines()]
    assert ids == list(range(250))
    assert tables.outcome_digest(outcomes.repartition(7), ["id"]).first()[:] == (hashlib.sha256(content).hexdigest(), 250)
    runs = [hashlib.sha256(b"".join(content.splitlines(True)[i : i + 100])).hexdigest() for i in (0, 100, 200)]
    assert tables.outcome_digest(outcomes, ["id"], lines=100).first()[:] == (hashlib.sha256("".join(runs).encode()).hexdigest(), 250)
    tables.write_outcomes(outcomes, str(tmp_path / "c"), ["id"], "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 250
    with pytest.raises(ValueError, match="split"):
        tables.write_outcomes(outcomes.withColumn("split", F.lit("train")), str(tmp_path / "x"), ["id"])
    assert tables.outcome_digest(outcomes.limit(0), ["id"]).first().n_rows == 0


def test_freeze_records_have_no_open_field():
    record = json.loads(tables.freeze_record("protocol", {"b": 1, "a": "x"}, ["a", "b"]))
    body = {"fields": {"a": "x", "b": 1}, "kind": "protocol"}
    assert record["record_sha256"] == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    with pytest.raises(ValueError, match="c"):
        tables.freeze_record("protocol", {"a": "x", "c": "TBD"}, ["a", "c"])


def test_source_pools_come_from_any_reader(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<html><body><p>One two.</p><script>x</script></body></html>")
    (tmp_path / "in/b.txt").write_text("Plain  text\nhere")
    (tmp_path / "json").mkdir()
    (tmp_path / "json/c.json").write_text('{"document_id": "c", "text": "Said."}')
    pages = tables.SOURCES["html"](spark, str(tmp_path / "in"))
    manifest = {r.document_id: r for r in tables.write_source_pool(pages, str(tmp_path / "pool"), 100).collect()}
    assert {k: (r.token_count, r.sha256) for k, r in manifest.items()} == {"a.html": (3, hashlib.sha256(b"One two.").hexdigest()), "b.txt": (3, hashlib.sha256(b"Plain text\nhere").hexdigest())}
    assert {r.document_id for r in spark.read.option("header", True).csv(str(tmp_path / "pool/manifest")).collect()} == set(manifest)
    assert {r.text for r in tables.SOURCES["text"](spark, str(tmp_path / "in")).collect()} > {"Plain  text\nhere"} and tables.SOURCES["json"](spark, str(tmp_path / "json")).first().text == "Said."


def test_events_are_delivered_by_run_in_order(spark, tmp_path):
    log = spark.range(60).select((F.col("id") % 3).cast("string").alias("run_id"), (20 - F.floor(F.col("id") / 3)).alias("sequence"), F.lit("stage_done").alias("event_type"))
    log.write.parquet(str(tmp_path / "log"))
    sink = str(tmp_path)

    def send(run, messages):
        with open(f"{sink}/sent-{run}", "a") as f:
            f.writelines(messages)

    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    events.deliver(stream, send, str(tmp_path / "state")).awaitTermination()
    for run in "012":
        sent = (tmp_path / f"sent-{run}").read_text().split("\n\n")[:-1]
        assert [m.split("\n")[0] for m in sent] == [f"id: {i}" for i in range(1, 21)] and json.loads(sent[0].split("data: ")[1])["run_id"] == run


def test_registries_and_guards(spark):
    with pytest.raises(ValueError):
        benchmark.register("vanilla_relay", benchmark.full_context)
    with pytest.raises(ValueError):
        learning.assert_learner("mock")
    with pytest.raises(ValueError):
        T.tokenizer("none")
    row = spark.createDataFrame([("One two. Three four five.",)], "t string").select(T.tokenizer("regex").count(F.col("t")).alias("n"), T.tokenizer("regex").truncate(F.col("t"), 4).alias("h"), benchmark.vanilla_relay(F.col("t"), 2).alias("r")).first()
    assert tuple(row) == (7, "One two. Three", "Three four")


def test_policy_of_trees_takes_the_best_setting(spark):
    rows = spark.range(300).select((F.col("id") % 30).cast("string").alias("document_id"), (F.col("id") % 10 / 10).alias("x"), F.when((F.col("id") % 10).between(3, 5), 1.0).otherwise(0.0).alias("y"), (F.col("id") % 30 % 3).alias("fold"))
    grid = [{"max_depth": 1, "max_iter": 1, "learning_rate": 0.01, "min_samples_leaf": 1}, {"max_depth": 2, "max_iter": 8, "learning_rate": 0.5, "min_samples_leaf": 1}]
    model = learning.fit_policy(rows, ["x"], "y", "HistGradientBoostingRegressor", grid)
    assert model["params"] == grid[1] and model["cv_mse"] < 0.01 and model["n_train_documents"] == 30
    assert model["fingerprint"] == learning.fit_policy(rows, ["x"], "y", "HistGradientBoostingRegressor", grid[1:])["fingerprint"]
    with pytest.raises(AssertionError):
        learning.fit_policy(rows, ["x"], "y", split="test")


def test_best_utilities_are_those_of_all_choices(spark):
    items = defaultdict(list)
    for r in adapters.order_atoms(spark, DATA).collect():
        items[r.document_id].append((r.tokens, r.discount - r.tax, r.transmitted))
    got = {r.document_id: r for r in catalog.queries()["knapsack_gstar"](spark, DATA).collect()}
    assert got.keys() == items.keys()
    for document, rows in items.items():
        best = max(sum(u for _, u, _ in chosen) for n in range(len(rows) + 1) for chosen in combinations(rows, n) if sum(c for c, _, _ in chosen) <= 60)
        assert got[document].g_star == pytest.approx(best, abs=1e-9) and got[document].g_obs == pytest.approx(sum(u for _, u, t in rows if t), abs=1e-9)


def test_instrumentation_takes_the_first_of_each_role_by_hash(spark):
    sizes, atoms = defaultdict(lambda: defaultdict(list)), adapters.order_atoms(spark, DATA)
    for r in atoms.collect():
        h = int(hashlib.sha256(f"7|{r.document_id}|{r.atom_id}".encode()).hexdigest()[:15], 16)
        sizes[r.document_id][r.role].append((h, r.atom_id))
    want = []
    for document, roles in sizes.items():
        names = sorted(roles)
        for role, take in zip(names, design.allocation(names, [len(roles[n]) for n in names], 4)):
            want += [(document, atom) for _, atom in sorted(roles[role])[:take]]
            assert sum(map(len, roles.values())) > 4 or take == len(roles[role])
    got = catalog.queries()["instrumentation_plan"](spark, DATA).where("selected").collect()
    assert sorted((r.document_id, r.atom_id) for r in got) == sorted(want)
    assert max(Counter(d for d, _ in want).values()) == 4 and min(len(want), sum(len(a) for r in sizes.values() for a in r.values()) - len(want)) > 0


def test_allocations_are_the_best_that_fit(spark):
    from tessera.functions import atoms as A

    frames = {r.document_id: r.text for r in adapters.disclosures(spark, DATA).collect()}
    got = {r.document_id: r for r in catalog.queries()["allocation"](spark, DATA).collect()}
    assert got.keys() == frames.keys()
    small = 0
    for document, text in frames.items():
        rows = []
        for a in A.atomize(document, text):
            h = int(hashlib.sha256(f"score|{document}|{a['atom_id']}".encode()).hexdigest()[:15], 16)
            rows.append((T.count_tokens(f"- {a['role']}: {a['canonical_value']}\n"), max(0.0, (h % 1000 - 200) / 1000)))
        assert got[document].tokens <= 60 and T.count_tokens(got[document].message) == got[document].tokens
        if len(rows) <= 10:
            best = max(sum(u for _, u in c) for n in range(len(rows) + 1) for c in combinations(rows, n) if sum(x for x, _ in c) <= 60)
            assert got[document].utility == pytest.approx(best, abs=1e-6)
            small += 1
    assert small > 100


def test_masked_contexts_hide_the_value(spark):
    rows = catalog.queries()["masked_contexts"](spark, DATA).collect()
    assert rows and all(r.context.count("<TARGET>") == 1 and not M.find_spans(r.context.replace("<TARGET>", " "), r.canonical_value, r.role) for r in rows)


def test_pages_lose_their_markup(spark):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in adapters.read(spark, DATA, "pages").collect()}
    words = lambda t: re.findall(r"\w+", t)
    got = catalog.queries()["html_to_text"](spark, DATA).collect()
    for r in got:
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " ", pages[r.page_id])
        assert words(r.text) == words(unescape(re.sub(r"(?s)<[^>]*>", "\x00", bare)).replace("\x00", "")) or words(r.text) == words(unescape(re.sub(r"(?s)<[^>]*>", "\n", bare)))
    assert len(got) == len(pages)


def test_long_files_are_hashed_in_steps(spark, tmp_path, monkeypatch):
    """Files beyond what a task reads whole: of any bytes, with and without a last line's end, in splits of the reader; no task is given more than a step."""
    rng = random.Random(3)
    contents = {
        "random.bin": rng.randbytes(300_000), "line's end.txt": b"a line\n" * 30_000, "no end+x.txt": b"a line\n" * 30_000 + b"rest", "mark.txt": b"\xef\xbb\xbf" + b"marked\r\n" * 20_000, "marked no end": b"\xef\xbb\xbf" + b"x\n" * 50_000 + b"y",
        "blank": b"\n" * 120_000, "one line": b"x" * 200_000, "zeros%20.bin": bytes(150_000), "packed.gz": gzip.compress(rng.randbytes(200_000)), "short": b"short", "exact": rng.randbytes(65_536), "over": rng.randbytes(65_537),
    }
    (tmp_path / "in [a]" / "deep").mkdir(parents=True)
    for i, (name, content) in enumerate(contents.items()):
        (tmp_path / "in [a]" / ("deep" if i % 2 else "") / name).write_bytes(content)
    monkeypatch.setattr(tables, "WHOLE_BYTES", 1 << 16)
    monkeypatch.setattr(tables, "STEP_BYTES", 1 << 16)
    monkeypatch.setattr(tables, "PIECE_BYTES", 1 << 10)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 14)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 300_000 - 1)  # the longest could not be read whole
    try:
        got = {r.path.rsplit("/", 1)[-1]: (r.sha256, r.bytes) for r in tables.file_manifest(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {name: (hashlib.sha256(content).hexdigest(), len(content)) for name, content in contents.items()}
