import datetime

import pytest

from epochflow.streaming import jobs


@pytest.fixture()
def live(spark, tmp_path):
    """A folder of small files that arrive one after another."""

    def put(rows, schema):
        for k, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k:03d}")
        return jobs.replay(spark, f"file://{tmp_path}/in/*", spark.createDataFrame([], schema).schema)

    return put


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_windows_of_ragged_batches(live):
    stream = live([[(1, i, float(i)) for i in part] for part in (range(0, 5), range(5, 6), range(6, 23))], "c long, i long, x double")
    got = jobs.run_all(jobs.hop_windows(stream, "c", "i", "x", 8, 4), "w").orderBy("k").collect()
    assert [(r.k, r.start, r.signal[0], r.signal[-1]) for r in got] == [(k, 4 * k, 4.0 * k, 4.0 * k + 7) for k in range(4)]


def test_dwell_commits_by_row_and_by_timer(live):
    rows = [[(at(0), 1, "a"), (at(1), 1, "a")], [(at(3), 1, "b"), (at(3), 2, "c")], [(at(4), 1, None), (at(60), 3, "z")], [(at(61), 3, "y")], [(at(62), 3, "y")]]
    stream = live(rows, "ts timestamp, session long, target string")
    got = sorted((r.session, r.target) for r in jobs.run_all(jobs.dwell(stream, 2.0, "1 second"), "d").collect())
    assert got[:2] == [(1, "a"), (2, "c")]


def test_throttle_and_rates(live):
    rows = [[(at(0.0), 1, 1), (at(0.1), 1, 2), (at(0.3), 1, 3)], [(at(30), 1, 4)], [(at(90), 1, 5)]]
    stream = live(rows, "ts timestamp, session long, n long")
    assert sorted(r.n for r in jobs.run_all(jobs.throttled(stream), "t").collect())[:3] == [2, 3, 4]
    stream = live([], "ts timestamp, session long, n long")


def test_snapshots_keep_the_latest(spark, live, tmp_path):
    stream = live([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]], "session long, n long, command string")
    q = jobs.snapshots(stream, f"file://{tmp_path}/snap", f"file://{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    newest = max((tmp_path / "snap").glob("version=*"), key=lambda p: int(p.name.split("=")[1]))
    got = {r.session: r.command for r in spark.read.parquet(f"file://{newest}").collect()}
    assert got == {1: "c", 2: "b"}
