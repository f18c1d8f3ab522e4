"""Stage order and ledgers as streams: planted disorder, restarts, silence, batches that run twice."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import events as E

LOG = "run_id string, sequence long, stage string, event_type string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def log_of(spark, rows):
    return spark.createDataFrame([(r, s, stage, kind, START + dt.timedelta(minutes=m)) for r, s, stage, kind, m in rows], LOG)


def random_runs(seed, n=12):
    """Runs that go back, repeat, skip or name no stage now and then."""
    rng, rows = random.Random(seed), []
    for run in range(n):
        at, sequence = 0, 0
        for _ in range(rng.randint(5, 25)):
            sequence += 1 if rng.random() > 0.05 else 2
            at = max(0, min(12, at + rng.choice([1, 1, 1, 0, -1, 2])))
            stage = E.STAGES[at] if rng.random() > 0.05 else "tea_break"
            rows.append((f"r{run}", sequence, stage, E.STARTED if rng.random() > 0.3 else "stage.progress", sequence))
    return rows


def expected(rows):
    """(run, sequence, expected, in sequence, in order), event by event."""
    out, state = set(), {}
    for run, sequence, stage, kind, _ in sorted(rows):
        last, farthest = state.get(run, (0, -1))
        at = E.STAGES.index(stage) if stage in E.STAGES else -1
        started = kind == E.STARTED
        out.add((run, sequence, last + 1, sequence == last + 1, not started or at > farthest))
        state[run] = (max(last, sequence), max(farthest, at) if started else farthest)
    return out


def test_stage_order_over_restarts_equals_the_batch(spark, tmp_path):
    rows = random_runs(5)
    folder, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    for low, high in ((0, 6), (6, 7), (7, 99)):
        log_of(spark, [r for r in rows if low < r[1] <= high]).write.mode("append").parquet(folder)
        E.start(E.watched_stream(spark.readStream.schema(LOG).parquet(folder)), out, state).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).drop("kind").collect()]
    assert len(got) == len(rows) and set(got) == expected(rows)
    batch = {(r.run_id, r.sequence) for r in E.topology_violations(log_of(spark, rows)).collect()}
    assert batch == {(r, s) for r, s, _, _, ok in expected(rows) if not ok} and batch


def test_a_repeated_start_breaks_the_order_and_progress_does_not(spark):
    rows = [("a", 1, "relay", E.STARTED, 0), ("a", 2, "atomize", "stage.progress", 1), ("a", 3, "relay", "stage.progress", 2), ("a", 4, "relay", E.STARTED, 3), ("a", 5, "estimate", E.STARTED, 4), ("a", 6, "finalize_run", E.STARTED, 5)]
    assert [(r.run_id, r.sequence) for r in E.topology_violations(log_of(spark, rows)).collect()] == [("a", 4)]


def test_idle_runs_are_told_and_finished_ones_are_not(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    parts = [[("idle", 1, "relay", E.STARTED, 0), ("done", 1, "finalize_run", E.STARTED, 0), ("busy", 1, "relay", E.STARTED, 0)], [("busy", 2, "relay", "stage.progress", 30)], [("busy", 3, "relay", "stage.progress", 31)]]
    for part in parts:
        log_of(spark, part).coalesce(1).write.mode("append").parquet(folder)
        E.start(E.watched_stream(spark.readStream.schema(LOG).parquet(folder), "10 minutes"), out, state).awaitTermination()
    told = {(r.run_id, r.sequence) for r in spark.read.parquet(out).where("kind = 'idle'").collect()}
    assert ("idle", 1) in told and not any(r == "done" for r, _ in told)
    assert spark.read.parquet(out).where("kind = 'event'").count() == 5


CALLS = "provider string, status string, attempt int, input_tokens long, output_tokens long, latency_s double"


@pytest.fixture
def calls(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice(["ok", "failed"]), rng.randint(1, 2), rng.choice([-1, 5, 9]), rng.choice([-1, 3]), 0.5) for _ in range(90)]
    df = spark.createDataFrame(rows, CALLS)
    df.repartition(5).write.parquet(str(tmp_path / "calls"))
    return df


def totals(df):
    return sorted(tuple(r) for r in df.select("provider", "status", "n_calls", "input_tokens", "output_tokens", "n_retries", "latency_s").collect())


def test_ledger_batches_that_run_twice_count_once(spark, tmp_path, calls):
    sums = str(tmp_path / "sums")
    stream = lambda: spark.readStream.option("maxFilesPerTrigger", 2).schema(CALLS).parquet(str(tmp_path / "calls"))
    E.ledger_stream(stream(), sums, str(tmp_path / "one")).awaitTermination()
    want = totals(E.ledger_summary(calls))
    assert totals(E.ledger_totals(spark, sums)) == want
    assert len(list((tmp_path / "sums").glob("batch=*"))) == 3
    E.ledger_stream(stream(), sums, str(tmp_path / "two")).awaitTermination()  # its memory lost: all batches run again
    assert totals(E.ledger_totals(spark, sums)) == want
    E.compact_ledger(spark, sums, 1)
    assert sorted(p.name for p in (tmp_path / "sums").glob("batch=*")) == ["batch=1", "batch=2"]
    assert totals(E.ledger_totals(spark, sums)) == want


def test_compaction_goes_on_after_a_break(spark, tmp_path, calls):
    sums = str(tmp_path / "sums")
    E.ledger_stream(spark.readStream.option("maxFilesPerTrigger", 1).schema(CALLS).parquet(str(tmp_path / "calls")), sums, str(tmp_path / "one")).awaitTermination()
    want = totals(E.ledger_totals(spark, sums))
    E.ledger_totals(spark, sums).coalesce(1).write.parquet(f"{sums}-upto-4")  # written, and two of the five already deleted
    for number in (0, 3):
        for f in (tmp_path / "sums" / f"batch={number}").iterdir():
            f.unlink()
        (tmp_path / "sums" / f"batch={number}").rmdir()
    E.compact_ledger(spark, sums, 4)
    assert totals(E.ledger_totals(spark, sums)) == want
