"""Run events and provider calls, as batches and as streams.

The log is append-only; within a run the sequence starts at 1 without gaps and
each stage starts once, after those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Stages in order.
STAGES = ("prepare_run", "load_source", "atomize", "sample_focals", "relay", "match_transmission", "natural_receiver", "construct_interventions", "counterfactual_receiver", "deterministic_match", "estimate", "export_artifacts", "finalize_run")
#: Fixed value: the type of the events whose stages must follow that order.
STARTED = "stage.started"


def replay(events: DataFrame, cursor: int) -> DataFrame:
    """Events strictly after a cursor."""
    if cursor < 0:
        raise ValueError("the cursor must not be negative")
    return events.where(F.col("sequence") > cursor)


def sse(events: DataFrame) -> DataFrame:
    """(run_id, sequence, message): each event as a server-sent event, its fields as compact JSON in sorted order."""
    data = F.to_json(F.struct(*sorted(events.columns)))
    message = F.concat(F.lit("id: "), F.col("sequence").cast("string"), F.lit("\nevent: "), "event_type", F.lit("\ndata: "), data, F.lit("\n\n"))
    return events.select("run_id", "sequence", message.alias("message"))


def deliver(events: DataFrame, send, checkpoint: str):
    """A query that hands a stream's events to `send`, run by run and in order, from the tasks that hold them.

    send(run_id, messages) is called in the executors, once for each run of
    a batch, and again where a task is run again: receivers go by the id.
    """

    def batch(df: DataFrame, number: int) -> None:
        def run(frame):
            ordered = frame.sort_values("sequence")
            send(ordered["run_id"].iloc[0], ordered["message"].tolist())
            return ordered[["run_id"]].head(1)

        sse(df).groupBy("run_id").applyInPandas(run, "run_id string").write.format("noop").mode("append").save()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monotonic_violations(events: DataFrame) -> DataFrame:
    """Events whose sequence is not their place in the run."""
    place = F.row_number().over(W.partitionBy("run_id").orderBy("sequence"))
    return events.withColumn("expected", place).where(F.col("expected") != F.col("sequence"))


def _stage_at() -> Column:
    """A stage's place in the order from 1; 0 for none."""
    return F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int")


def topology_violations(events: DataFrame) -> DataFrame:
    """Starts of a stage that is not beyond all stages the run has started, or of no known stage; other events do not count."""
    started = events.where(F.col("event_type") == STARTED).withColumn("_at", F.coalesce(_stage_at(), F.lit(0)))
    before = F.max("_at").over(W.partitionBy("run_id").orderBy("sequence").rowsBetween(W.unboundedPreceding, -1))
    return started.withColumn("_before", before).where((F.col("_at") == 0) | (F.col("_at") <= F.col("_before"))).drop("_at", "_before")


def ledger_summary(calls: DataFrame) -> DataFrame:
    """Calls, tokens (unknown counts of -1 as none), retries and time for each provider and status."""
    tokens = lambda c: F.sum(F.greatest(F.lit(0), F.col(c)))
    return calls.groupBy("provider", "status").agg(
        F.count("*").alias("n_calls"), tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"),
        F.count_if(F.col("attempt") > 1).alias("n_retries"), F.sum("latency_s").alias("latency_s"),
    )


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with cost_usd: tokens (unknown ones as none) at their provider's prices for a million; null without a price.

    prices: (provider, input_usd, output_usd), a short list.
    """
    known = lambda c: F.greatest(F.lit(0), F.col(c))
    cost = (known("input_tokens") * F.col("input_usd") + known("output_tokens") * F.col("output_usd")) / 1e6
    return calls.join(prices, "provider", "left").withColumn("cost_usd", cost).drop("input_usd", "output_usd")


def cost_ledger(costed: DataFrame, ceiling: float) -> DataFrame:
    """Spending by provider and in all (provider null), calls without a price, and whether the whole stays under the ceiling."""
    out = costed.rollup("provider").agg(F.count("*").alias("n_calls"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spend_usd"), F.count_if(F.col("cost_usd").isNull()).alias("n_unpriced"))
    return out.withColumn("ceiling_respected", F.when(F.col("provider").isNull(), F.col("spend_usd") <= ceiling))


def append_stream(events: DataFrame, folder: str, checkpoint: str):
    """A query that appends a stream of events to a folder as JSON, once through what is there."""
    return events.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checked_stream(events: DataFrame) -> DataFrame:
    """(run_id, sequence, expected, ok) of a stream: the state of a run is its last sequence.

    A batch's events of a run are taken in the order of their sequence.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def check(key, frames, state):
        last = state.get[0] if state.exists else 0
        rows = pd.concat(frames).sort_values("sequence")
        out = []
        for s in rows["sequence"]:
            out.append((key[0], int(s), last + 1, int(s) == last + 1))
            last = max(last, int(s))
        state.update((last,))
        yield pd.DataFrame(out, columns=["run_id", "sequence", "expected", "ok"])

    return events.groupBy("run_id").applyInPandasWithState(check, "run_id string, sequence long, expected long, ok boolean", "last long", "append", GroupStateTimeout.NoTimeout)


#: The state store that transformWithState needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _run_watcher(idle_ms: int):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class RunWatcher(StatefulProcessor):
        """Of each run the last sequence and the farthest stage started, and a timer for silence."""

        def init(self, handle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "last long, farthest int")

        def handleInputRows(self, key, rows, timerValues):
            last, farthest = self.seen.get() if self.seen.exists() else (0, 0)
            frame = pd.concat(rows).sort_values("sequence")
            out, latest = [], 0
            for sequence, event_type, at, ts in zip(frame["sequence"], frame["event_type"], frame["stage_at"], frame["ts"]):
                started = event_type == STARTED
                ok = not started or (at > 0 and at > farthest)
                out.append((key[0], int(sequence), last + 1, int(sequence) == last + 1, bool(ok), "event"))
                last, farthest = max(last, int(sequence)), max(farthest, int(at)) if started else farthest
                latest = max(latest, int(ts.timestamp() * 1000))
            self.seen.update((last, farthest))
            if idle_ms:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if farthest < len(STAGES):
                    self.handle.registerTimer(latest + idle_ms)
            yield pd.DataFrame(out, columns=["run_id", "sequence", "expected", "in_sequence", "in_order", "kind"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last, _ = self.seen.get() if self.seen.exists() else (0, 0)
            yield pd.DataFrame([(key[0], int(last), int(last) + 1, True, True, "idle")], columns=["run_id", "sequence", "expected", "in_sequence", "in_order", "kind"])

        def close(self) -> None:
            pass

    return RunWatcher()


def watched_stream(events: DataFrame, idle: str | None = None) -> DataFrame:
    """(run_id, sequence, expected, in_sequence, in_order, kind) of a stream (run_id, sequence, stage, event_type, ts).

    One row for each event: whether its sequence follows the run's last, and,
    for the start of a stage, whether the stage is beyond all that the run has
    started. With idle, an interval such as "10 minutes", also one row of kind
    `idle`, with the last sequence, for a run whose last stage has not started
    when the watermark is that far past its last event. What a run has reached
    is state, so a restarted query goes on where it was. A batch's events of a
    run are taken in the order of their sequence. Start it with `start`.
    """
    rows = events.select("run_id", "sequence", "event_type", F.coalesce(_stage_at(), F.lit(0)).alias("stage_at"), "ts")
    idle_ms = 0
    if idle:
        idle_ms = events.sparkSession.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {idle}"))).first()[0]
        rows = rows.withWatermark("ts", "0 seconds")
    schema = "run_id string, sequence long, expected long, in_sequence boolean, in_order boolean, kind string"
    return rows.groupBy("run_id").transformWithStateInPandas(_run_watcher(idle_ms), schema, "Append", "EventTime" if idle else "None")


def start(stream: DataFrame, folder: str, checkpoint: str):
    """A query that appends a stream with state to a folder of Parquet, once through what is there, with the store its state needs."""
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE[0])
    conf.set(*STATE_STORE)
    try:
        return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(STATE_STORE[0], before)


def ledger_stream(calls: DataFrame, folder: str, checkpoint: str):
    """A query that keeps a ledger's sums in files, each batch's under its own number.

    A batch that is run again, after a failure or because a checkpoint was
    lost with its last entry, writes the same folder anew, so no call counts
    twice. Nothing passes the driver. `ledger_totals` reads the sums.
    """

    def commit(batch: DataFrame, number: int) -> None:
        # one file: as many rows as there are providers and states
        ledger_summary(batch).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return calls.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LEDGER = "provider string, status string, n_calls long, input_tokens long, output_tokens long, n_retries long, latency_s double"


def ledger_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's summary over all batches committed."""
    batches = spark.read.schema(f"{LEDGER}, batch long").parquet(folder)
    return batches.groupBy("provider", "status").agg(*(F.sum(c).alias(c) for c in ("n_calls", "input_tokens", "output_tokens", "n_retries", "latency_s")))


def compact_ledger(spark: SparkSession, folder: str, upto: int) -> None:
    """Put the batches up to a number into one, under that number, and delete the others.

    The sums are written beside the folder first and then take the place of
    the last batch; if this breaks off in between, `compact_ledger` with the
    same number finds what was written and goes on.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    ready, last = fs_path(f"{folder}-upto-{upto}"), fs_path(folder, f"batch={upto}")
    if not fs.exists(fs_path(ready, "_SUCCESS")):
        batches = spark.read.schema(f"{LEDGER}, batch long").parquet(folder).where(F.col("batch") <= upto)
        sums = batches.groupBy("provider", "status").agg(*(F.sum(c).alias(c) for c in ("n_calls", "input_tokens", "output_tokens", "n_retries", "latency_s")))
        sums.coalesce(1).write.mode("overwrite").parquet(ready.toString())
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) <= upto:
            fs.delete(f.getPath(), True)
    fs.rename(ready, last)
