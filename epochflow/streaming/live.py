"""The live path as chained state: backlog of windows, decisions, selections with undo, pauses; snapshots and rates.

Each processor keeps one session's state in the state store and shares its transitions with the batch form beside it,
so a stream gives what a batch over the same rows gives, however the rows are cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from epochflow.operators.decide import DISPATCHED, Decider, Tree
from epochflow.operators.windows import last_known
from epochflow.sources.scratch import scratch_path
from epochflow.streaming.jobs import WATERMARK

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def state_store(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which these processors need; the session's setting is put back."""
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        yield
    finally:
        spark.conf.unset(_STORE[0]) if before is None else spark.conf.set(_STORE[0], before)


def run_all(out: DataFrame, name: str) -> DataFrame:
    """Runs a stream of these processors over what is there now; returns the rows it wrote (Parquet, in the shared folder)."""
    spark, at = out.sparkSession, scratch_path(out.sparkSession, name)
    with state_store(spark):
        query = out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


# Backlog

SERVED, DROPPED, AGED = "served", "dropped", "aged"


@dataclass
class Backlog:
    """Windows that wait for a consumer, which takes the oldest one at each multiple of `every` ms.

    No more than `most` wait: a further one pushes out the oldest (dropped). At a tick, windows older than `keep` ms are
    lost before one is taken (aged). tick: the last tick that took a window.
    """

    most: int
    every: int
    keep: int
    waiting: list[tuple[int, int]] = field(default_factory=list)
    tick: int = -1

    def due(self) -> int | None:
        """The next tick that finds a window."""
        if not self.waiting:
            return None
        return max(-(-self.waiting[0][1] // self.every) * self.every, self.tick + self.every if self.tick >= 0 else 0)

    def until(self, now: int) -> list[tuple[int, int, int, str]]:
        """(n, t, at, fate) of what ticks up to now decide."""
        out = []
        while (tick := self.due()) is not None and tick <= now:
            while self.waiting and tick - self.waiting[0][1] > self.keep:
                out.append((*self.waiting.pop(0), tick, AGED))
            if self.waiting:
                out.append((*self.waiting.pop(0), tick, SERVED))
                self.tick = tick
        return out

    def arrive(self, n: int, t: int) -> list[tuple[int, int, int, str]]:
        """The same for a window that arrives at t, once the ticks before it have been."""
        out = self.until(t - 1)
        self.waiting.append((n, t))
        if len(self.waiting) > self.most:
            out.append((*self.waiting.pop(0), t, DROPPED))
        return out


_FATES = "session bigint, n bigint, t_ms bigint, at_ms bigint, fate string"
_FATE = [c.split()[0] for c in _FATES.split(", ")]


class _Backpressure(StatefulProcessor):
    def __init__(self, most: int, every: int, keep: int):
        self.limits = (most, every, keep)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.tick = handle.getListState("waiting", "n bigint, t bigint"), handle.getValueState("tick", "t bigint")

    def _load(self) -> Backlog:
        return Backlog(*self.limits, [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else [], self.tick.get()[0] if self.tick.exists() else -1)

    def _keep(self, b: Backlog) -> None:
        if b.waiting:
            self.waiting.put(b.waiting)
        else:
            self.waiting.clear()
        self.tick.update((b.tick,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if b.waiting:
            self.handle.registerTimer(b.due())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        b, out = self._load(), []
        new = pd.concat(list(rows)).sort_values(["t_ms", "n"])
        for n, t in zip(new["n"].tolist(), new["t_ms"].tolist()):
            out += b.arrive(n, t)
        self._keep(b)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=_FATE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        b = self._load()
        out = b.until(timerValues.getCurrentWatermarkInMs())
        self._keep(b)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=_FATE)

    def close(self) -> None:
        pass


def backpressure(stream: DataFrame, most: int = 3, every: int = 250, keep: int = 10_000, watermark: str = WATERMARK) -> DataFrame:
    """(session, n, t_ms, at_ms, fate) of windows (session, n, ts, t_ms) as soon as it is settled: served, dropped or aged."""
    rows = stream.select("session", "n", "ts", "t_ms").withWatermark("ts", watermark)
    return rows.groupBy("session").transformWithStateInPandas(_Backpressure(most, every, keep), _FATES, "Append", "EventTime")


def backlog(df: DataFrame, until: int, most: int = 3, every: int = 250, keep: int = 10_000) -> DataFrame:
    """The same for a table of windows; what is not settled up to `until` (ms) gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, b = None, Backlog(most, every, keep)
        for batch in batches:
            out = []
            for s, n, t in zip(batch["session"].tolist(), batch["n"].tolist(), batch["t_ms"].tolist()):
                if s != at:
                    out += [(at, *x) for x in b.until(until)]
                    at, b = s, Backlog(most, every, keep)
                out += [(s, *x) for x in b.arrive(n, t)]
            yield pd.DataFrame(out, columns=_FATE)
        yield pd.DataFrame([(at, *x) for x in b.until(until)], columns=_FATE)

    return df.select("session", "n", "t_ms").repartition("session").sortWithinPartitions("session", "t_ms", "n").mapInPandas(run, _FATES)


# Decisions and selections

@dataclass
class Chooser:
    """A Tree of n targets that commands move: left, right and undo; other commands do nothing."""

    tree: Tree
    left: str
    right: str
    undo: str

    def step(self, command: str) -> int | None:
        if command == self.undo:
            self.tree.undo()
        elif command in (self.left, self.right):
            return self.tree.decide(command == self.left)
        return None


def _rows(batches: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """A session's new rows in order of n, which comes first, as plain tuples: sessions are many and their rows few."""
    return sorted((r for b in batches for r in zip(*(b[c].tolist() for c in columns))), key=lambda r: r[0])


class _Decisions(StatefulProcessor):
    """Windows to dispatched commands; the event time goes on with the rows, for what is chained behind.

    What stays undispatched goes no further, so a session without commands sends nothing on. A state is read once and
    written only where it has changed: each is a round trip to the store.
    """

    def __init__(self, run: int, lockout: float, refractory: float):
        self.limits = (run, lockout, refractory)

    def init(self, handle) -> None:
        self.state = handle.getValueState("decider", "label string, run int, locked_until double, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        d = Decider(*held) if held is not None else Decider()
        out = [(key[0], ts, n, c) for n, ts, t, c, a in _rows(rows, "n", "ts", "t_ms", "command", "is_artifact") if d.step(t, c, a, *self.limits) == DISPATCHED]
        new = (d.run_label if isinstance(d.run_label, str) else None, d.run, float(d.locked_until), None if d.last is None else float(d.last))
        if held is None or new != tuple(held):
            self.state.update(new)
        if out:
            yield pd.DataFrame(out, columns=["session", "ts", "n", "command"])

    def close(self) -> None:
        pass


class _Selections(StatefulProcessor):
    def __init__(self, targets: int, left: str, right: str, undo: str):
        self.targets, self.commands = targets, (left, right, undo)

    def init(self, handle) -> None:
        self.state = handle.getValueState("path", "path array<boolean>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tree = Tree(self.targets)
        held = self.state.get()
        for left in held[0] if held is not None else ():
            tree.decide(bool(left))
        c = Chooser(tree, *self.commands)
        out = [(key[0], ts, n, command, c.step(command)) for n, ts, command in _rows(rows, "n", "ts", "command")]
        if list(tree.path) != (list(held[0]) if held is not None else []):
            self.state.update((list(tree.path),))
        chosen = pd.array([r[4] for r in out], dtype="Int64")
        yield pd.DataFrame([r[:4] for r in out], columns=["session", "ts", "n", "command"]).assign(chosen=chosen)

    def close(self) -> None:
        pass


def selections(stream: DataFrame, targets: int, left: str, right: str, undo: str, run: int = 3, lockout: float = 800, refractory: float = 1200, watermark: str = WATERMARK) -> DataFrame:
    """(session, ts, n, command, chosen): the dispatched commands of windows, and the target each selects, if it does.

    One append query with two states a session: the decision machine, and behind it a tree of targets with undo.
    """
    rows = stream.select("session", "ts", "n", "t_ms", "command", "is_artifact").withWatermark("ts", watermark)
    sent = rows.groupBy("session").transformWithStateInPandas(_Decisions(run, lockout, refractory), "session bigint, ts timestamp, n bigint, command string", "Append", "EventTime", eventTimeColumnName="ts")
    return sent.groupBy("session").transformWithStateInPandas(_Selections(targets, left, right, undo), "session bigint, ts timestamp, n bigint, command string, chosen bigint", "Append", "EventTime", eventTimeColumnName="ts")


# Pauses

def suppressed(df: DataFrame, keys: list[str], order: str, time: str, kind: Column, quiet: float = 3200) -> DataFrame:
    """Adds kept: whether a window counts, of rows whose kind is pause, resume, feedback or null for a window.

    From a pause to the next resume none counts, nor for `quiet` ms after a resume or feedback; events never count. What
    stands before a row is carried over ranges of the order, so a session is never ordered as a whole.
    """
    rows = df.withColumns({"_pause": F.when(kind.isin("pause", "resume"), kind == "pause"), "_quiet": F.when(kind.isin("resume", "feedback"), F.col(time))})
    rows = last_known(last_known(rows, keys, order, "_pause", "_paused"), keys, order, "_quiet", "_since")
    open_ = ~F.coalesce("_paused", F.lit(False)) & F.coalesce(F.col(time) - F.col("_since") >= quiet, F.lit(True))
    return rows.withColumn("kept", kind.isNull() & open_).drop("_pause", "_quiet", "_paused", "_since")


class _Suppressed(StatefulProcessor):
    def __init__(self, quiet: float):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.state = handle.getValueState("pause", "paused boolean, since bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        paused, since = self.state.get() if self.state.exists() else (False, None)
        new, kept = pd.concat(list(rows)).sort_values("n"), []
        for kind, t in zip(new["kind"], new["t_ms"].tolist()):
            if kind in ("pause", "resume"):
                paused = kind == "pause"
            if kind in ("resume", "feedback"):
                since = t
            kept.append(not isinstance(kind, str) and not paused and (since is None or t - since >= self.quiet))
        self.state.update((paused, since))
        yield new.assign(kept=kept)[["session", "n", "kept"]]

    def close(self) -> None:
        pass


def suppressed_stream(stream: DataFrame, quiet: float = 3200) -> DataFrame:
    """(session, n, kept) of rows (session, n, t_ms, kind) as they come; see suppressed()."""
    rows = stream.select("session", "n", "t_ms", "kind")
    return rows.groupBy("session").transformWithStateInPandas(_Suppressed(quiet), "session bigint, n bigint, kept boolean", "Append", "None")


# Snapshots and rates

def current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table of the last version that a pointer names; empty before the first."""
    names = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={max(names)}") if names else spark.createDataFrame([], schema)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions whose data are whole: a pointer is written after them."""
    try:
        return [r[0] for r in spark.read.schema("number bigint").parquet(f"{path}/pointer=*").collect()]  # one row a version
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def publish(batch: DataFrame, number: int, path: str, key: str, order: str) -> None:
    """Writes version `number` (the newest row of each key, of the batch and the version before), then its pointer.

    A batch that comes again gives the same version: it starts from the last pointer below its own number. Readers go
    by pointers, so they never see a version that is half written.
    """
    spark = batch.sparkSession
    before = [n for n in _versions(spark, path) if n < number]
    old = spark.read.schema(batch.schema).parquet(f"{path}/version={max(before)}") if before else batch.limit(0)
    newest = old.unionByName(batch).groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
    newest.write.mode("overwrite").parquet(f"{path}/version={number}")
    spark.createDataFrame([(number,)], "number bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer={number}")


def versioned(out: DataFrame, path: str, checkpoint: str, key: str = "session", order: str = "n"):
    """Keeps the newest row of each key as a versioned table; returns a writer to be started."""
    return out.writeStream.foreachBatch(lambda batch, number: publish(batch, number, path, key, order)).option("checkpointLocation", checkpoint)


class RateWatch(StreamingQueryListener):
    """Progress of the session's streams: query name, batch, rows, and rows a second that came and were processed."""

    def __init__(self):
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((p.name, p.batchId, p.numInputRows, p.inputRowsPerSecond, p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "query string, batch bigint, rows bigint, in_per_second double, done_per_second double")
