"""The live path: streams of ragged files against loops and batch forms; snapshots by pointer; the rate listener."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from epochflow.streaming import jobs, live

BEGIN = datetime.datetime(2024, 1, 1)


@pytest.fixture()
def files(spark, tmp_path):
    """A stream of small files that arrive one after another."""

    def put(parts, schema):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k:03d}")
        return jobs.replay(spark, f"file://{tmp_path}/in/*", spark.createDataFrame([], schema).schema)

    return put


def ragged(rows, seed):
    rng, out = random.Random(seed), []
    while rows:
        k = rng.choice([1, 2, 7, 40])
        out.append(rows[:k])
        rows = rows[k:]
    return out


def loop(times, most, every, keep, until):
    """One session, tick by tick of one millisecond."""
    waiting, out, arrivals = [], [], dict()
    for n, t in enumerate(times):
        arrivals.setdefault(t, []).append(n)
    for now in range(max(until, max(times)) + 1):
        for n in arrivals.get(now, ()):
            waiting.append((n, now))
            if len(waiting) > most:
                out.append((*waiting.pop(0), now, "dropped"))
        # rows of one moment have all come before the tick of that moment
        if now % every == 0 and now <= max(until, max(times) - 1):
            while waiting and now - waiting[0][1] > keep:
                out.append((*waiting.pop(0), now, "aged"))
            if waiting:
                out.append((*waiting.pop(0), now, "served"))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_backpressure_is_the_loop_in_any_batches(spark, files, seed):
    rng = random.Random(seed)
    times = {s: sorted(rng.sample(range(12_000), 60)) for s in (1, 2)}
    rows = sorted(((t, s, n) for s in times for n, t in enumerate(times[s])))
    rows = [(s, n, BEGIN + datetime.timedelta(milliseconds=t), t + int(BEGIN.timestamp() * 1000)) for t, s, n in rows]
    start = int(BEGIN.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    rows = [(s, n, ts, start + (ts - BEGIN) // datetime.timedelta(milliseconds=1)) for s, n, ts, _ in rows]
    limits = {"most": 3, "every": 250, "keep": 600}
    schema = "session long, n long, ts timestamp, t_ms long"
    until = max(t for *_, t in rows) - 1000
    got = {tuple(r) for r in live.run_all(live.backpressure(files(ragged(rows, seed), schema), **limits, watermark="1 second"), "fates").collect()}
    batch = {tuple(r) for r in live.backlog(spark.createDataFrame(rows, schema), until, **limits).collect()}
    assert got == batch and {r[4] for r in got} == {"served", "dropped", "aged"}
    for s in times:
        mine = sorted((n, t - start, at - start, fate) for k, n, t, at, fate in batch if k == s)
        assert mine == loop(times[s], 3, 250, 600, until - start)


def test_selections_of_ragged_batches_with_undo(spark, files):
    rng = random.Random(3)
    rows = [(s, BEGIN + datetime.timedelta(seconds=n), n, 1000 * n, rng.choice(["l", "r", "u", "x", None]), rng.random() < 0.05) for n in range(150) for s in (1, 2)]
    schema = "session long, ts timestamp, n long, t_ms long, command string, is_artifact boolean"
    out = live.selections(files(ragged(rows, 4), schema), 5, "l", "r", "u", run=1, lockout=1500, refractory=500)
    got = {(r.session, r.n): r.chosen for r in live.run_all(out, "selections").collect()}
    from epochflow.operators.decide import DISPATCHED, Decider, Tree

    for s in (1, 2):
        d, tree, want = Decider(), Tree(5), {}
        for k, _, n, t, command, artifact in rows:
            if k == s and d.step(t, command, artifact, 1, 1500, 500) == DISPATCHED:
                want[k, n] = tree.undo() if command == "u" else tree.decide(command == "l") if command in "lr" else None
        assert {k: v for k, v in got.items() if k[0] == s} == want
    assert sum(v is not None for v in got.values()) > 10


def test_pauses_over_ranges_and_in_ragged_batches(spark, files, monkeypatch):
    rng = random.Random(5)
    rows = [(s, n, 400 * n, rng.choice(["pause", "resume", "feedback", *[None] * 60])) for n in range(300) for s in (1, 2, 3)]
    schema = "session long, n long, t_ms long, kind string"
    want = {}
    for s in (1, 2, 3):
        paused, since = False, None
        for k, n, t, kind in rows:
            if k == s:
                paused = kind == "pause" if kind in ("pause", "resume") else paused
                since = t if kind in ("resume", "feedback") else since
                want[k, n] = kind is None and not paused and (since is None or t - since >= 3200)
    got = live.run_all(live.suppressed_stream(files(ragged(rows, 6), schema)), "kept").collect()
    assert {(r.session, r.n): r.kept for r in got} == want
    from epochflow.operators import windows

    short = windows.last_known
    monkeypatch.setattr(live, "last_known", lambda *a: short(*a, span=7))
    batch = live.suppressed(spark.createDataFrame(rows, schema), ["session"], "n", "t_ms", F.col("kind")).collect()
    assert {(r.session, r.n): r.kept for r in batch} == want and 100 < sum(want.values()) < 900


def test_snapshots_are_read_by_pointer(spark, tmp_path):
    path, schema = f"file://{tmp_path}/snapshot", "session long, n long, x double"
    of = lambda *rows: spark.createDataFrame(list(rows), schema)
    read = lambda: sorted(map(tuple, live.current(spark, path, of((0, 0, 0.0)).schema).collect()))
    assert read() == []
    live.publish(of((1, 1, 0.1), (1, 2, 0.2), (2, 1, 0.3)), 0, path, "session", "n")
    live.publish(of((2, 5, 0.5), (3, 1, 0.6)), 1, path, "session", "n")
    want = [(1, 2, 0.2), (2, 5, 0.5), (3, 1, 0.6)]
    assert read() == want
    live.publish(of((2, 5, 0.5), (3, 1, 0.6)), 1, path, "session", "n")  # the batch comes again
    assert read() == want
    of((9, 9, 9.0)).write.parquet(f"{path}/version=2")  # a version whose pointer was never written
    assert read() == want
    live.publish(of((1, 9, 0.9)), 2, path, "session", "n")
    assert read() == [(1, 9, 0.9), (2, 5, 0.5), (3, 1, 0.6)]


def test_the_listener_sees_each_batch(spark, files):
    import time

    watch = live.RateWatch()
    spark.streams.addListener(watch)
    try:
        rows = [(1, BEGIN + datetime.timedelta(seconds=n), n) for n in range(30)]
        jobs.run_all(jobs.rates(files([rows[:10], rows[10:]], "session long, ts timestamp, n long")), "watched").collect()
        for _ in range(100):
            if sum(r[2] for r in watch.rows) >= 30:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    seen = watch.table(spark).where("rows > 0").orderBy("batch").collect()
    assert [r.rows for r in seen] == [10, 20] and all(r.done_per_second > 0 for r in seen)


def test_a_session_without_commands_sends_nothing_on_and_reads_its_state_once():
    import pandas as pd

    class Store:
        def __init__(self):
            self.calls, self.held = [], None

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.held

        def exists(self):
            self.calls.append("exists")
            return self.held is not None

        def update(self, new):
            self.calls.append("update")
            self.held = new

    store, p = Store(), live._Decisions(2, 1500, 500)
    p.init(store)
    ts = pd.Timestamp(BEGIN)
    batch = lambda commands: iter([pd.DataFrame({"session": 1, "ts": ts, "n": range(len(commands)), "t_ms": [1000 * i for i in range(len(commands))], "command": commands, "is_artifact": False})])
    assert list(p.handleInputRows((1,), batch([None, None]), None)) == [] and store.calls == ["get", "update"]
    store.calls.clear()
    assert list(p.handleInputRows((1,), batch([None, None]), None)) == [] and store.calls == ["get"]
    (out,) = p.handleInputRows((1,), batch(["l", "l", "r"]), None)
    assert out.to_dict("list") == {"session": [1], "ts": [ts], "n": [1], "command": ["l"]}
