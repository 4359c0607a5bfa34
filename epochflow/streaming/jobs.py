"""Live forms: hop windows, decisions, dwell, throttling and rates over streams of samples or window predictions.

State is kept per session in the state store; transition functions are those of the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from epochflow.operators.decide import Decider
from epochflow.sources.scratch import scratch_path

#: How long rows may come late: what a 10-second sample buffer holds.
WATERMARK = "10 seconds"


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Recorded tables through the live path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hop_windows(stream: DataFrame, key: str, index: str, value: str, size: int, hop: int) -> DataFrame:
    """(key, k, start, signal) as soon as a window is full; samples of a key must come in order across batches.

    The state holds the samples that later windows need, fewer than size + hop.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, tail = state.get if state.exists else (0, [])
        new = pd.concat(list(batches)).sort_values("_i")
        tail, out = [*tail, *new["_x"]], []
        while len(tail) >= size:
            out.append((k[0], start // hop, start, tail[:size]))
            start, tail = start + hop, tail[hop:]
        state.update((start, [float(x) for x in tail]))
        yield pd.DataFrame(out, columns=[key, "k", "start", "signal"])

    rows = stream.select(key, F.col(index).alias("_i"), F.col(value).alias("_x"))
    kind = dict(stream.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, k bigint, start bigint, signal array<double>", "start bigint, tail array<double>", "append", GroupStateTimeout.NoTimeout)


def decide(stream: DataFrame, run: int = 3, lockout: float = 800, refractory: float = 1200) -> DataFrame:
    """The decision machine on window predictions (session, n, t_ms, command, is_artifact)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = Decider(*state.get) if state.exists else Decider()
        rows = pd.concat(list(batches)).sort_values("n")
        out = [(k[0], r.n, r.t_ms, r.command, d.step(r.t_ms, r.command, r.is_artifact, run, lockout, refractory)) for r in rows.itertuples()]
        state.update((d.run_label, d.run, float(d.locked_until), None if d.last is None else float(d.last)))
        yield pd.DataFrame(out, columns=["session", "n", "t_ms", "command", "state"])

    rows = stream.select("session", "n", "t_ms", "command", "is_artifact")
    return rows.groupBy("session").applyInPandasWithState(step, "session bigint, n bigint, t_ms bigint, command string, state string", "run_label string, run int, locked_until double, last double", "append", GroupStateTimeout.NoTimeout)


def dwell(stream: DataFrame, seconds: float = 2.0, watermark: str = WATERMARK) -> DataFrame:
    """(session, target, committed): a target is committed once it was armed for that long (ts, session, target).

    A row with another target arms that one; a null one disarms. The event-time timer fires when the watermark passes.
    """
    wait = int(1000 * seconds)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        target, since = state.get if state.exists else (None, 0)
        out = []
        if state.hasTimedOut:
            out.append((k[0], target, pd.Timestamp(since + wait, unit="ms")))
            state.remove()
        else:
            for r in pd.concat(list(batches)).sort_values("ts").itertuples():
                now = int(r.ts.timestamp() * 1000)
                if target is not None and now - since >= wait:
                    out.append((k[0], target, pd.Timestamp(since + wait, unit="ms")))
                    target = None
                if r.target != target:
                    target, since = r.target, now
            if target is None or target != target:
                if state.exists:
                    state.remove()
            else:
                state.update((target, since))
                state.setTimeoutTimestamp(max(since + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "target", "committed"])

    rows = stream.select("ts", "session", "target").withWatermark("ts", watermark)
    return rows.groupBy("session").applyInPandasWithState(step, "session bigint, target string, committed timestamp", "target string, since bigint", "append", GroupStateTimeout.EventTimeTimeout)


def throttled(stream: DataFrame, ts: str = "ts", every: str = "250 milliseconds", watermark: str = WATERMARK) -> DataFrame:
    """(session, slot, n): the newest window of each session in each slot of time."""
    slots = stream.withWatermark(ts, watermark).groupBy("session", F.window(ts, every).alias("w"))
    return slots.agg(F.max_by("n", ts).alias("n")).select("session", F.col("w.start").alias("slot"), "n")


def rates(stream: DataFrame, ts: str = "ts", every: str = "10 seconds", watermark: str = WATERMARK) -> DataFrame:
    """(session, slot, n): rows a slot, to watch the effective sampling rate."""
    out = stream.withWatermark(ts, watermark).groupBy("session", F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("session", F.col("w.start").alias("slot"), "n")


def with_profile(stream: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """The stream with each user's threshold (the default where there is none), and the gated command."""
    joined = stream.join(profiles.select("session", F.col("threshold").alias("_t")), "session", "left")
    limit = F.coalesce("_t", F.lit(threshold))
    return joined.withColumn("command", F.when(F.col("score") >= limit, F.col("predicted"))).drop("_t")


def run_all(out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns the rows it wrote (Parquet, in the shared folder)."""
    spark = out.sparkSession
    at = scratch_path(spark, name)
    query = out.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


def append_events(out: DataFrame, path: str, checkpoint: str):
    """Prediction, feedback and pause events as JSON lines; returns the running query."""
    return out.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).start()


def snapshots(out: DataFrame, path: str, checkpoint: str, key: str = "session", order: str = "n"):
    """Keeps the latest row of each key in a table: each micro-batch writes a new version, then `current` names it."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = lambda d: d.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        before = spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}") if number else batch.limit(0)
        newest(before.unionByName(batch)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return out.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).start()


def on_dispatch(out: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Hands the dispatched commands of each micro-batch to a callback, as a DataFrame, with the batch's number.

    A batch that was cut off comes again under its number, so what a callback does should be told apart by it. With
    `once` the query ends when it has seen what is there now.
    """
    writer = out.where("state = 'DISPATCHED'").writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
