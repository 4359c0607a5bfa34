"""Streaming queries, run over the event table as if it came live; their results are those of the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochflow.plans.analysis import _MACHINE
from epochflow.plans.base import DECISIONS, query, table
from epochflow.sources.scratch import scratch_path
from epochflow.streaming import jobs, live


def _events(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parque[t]"  # a pattern, as the table may be one file
    e = jobs.replay(spark, path, table(spark, sf, "events").schema)
    ts = F.col("ts").cast("timestamp")
    command = F.when(F.col("value") >= 10.0, F.col("event_type"))
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("n"), ts.alias("ts"), F.unix_millis(ts).alias("t_ms"), command.alias("command"), F.col("event_type").alias("predicted"), F.col("value").alias("score"), (F.col("event_type") == "error").alias("is_artifact"))


@query(f"{_MACHINE} SELECT m.session, count(*) AS windows, count_if(state = 'DISPATCHED') AS dispatched, count_if(state = 'LOCKOUT') AS locked FROM m WHERE n > 0 GROUP BY 1", longs="dispatched locked")
def i5_k14_stream_decisions(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_all(jobs.decide(_events(spark, sf), run=2, lockout=60_000_000, refractory=90_000_000), "decisions")
    return out.groupBy("session").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("state") == "DISPATCHED").alias("dispatched"), F.count_if(F.col("state") == "LOCKOUT").alias("locked"))


@query("WITH s AS (SELECT user_id AS session, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), w AS (SELECT session, k, value FROM s, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((i - 11) / 4.0) AS BIGINT)), i // 4 + 1)) AS k)) SELECT session, k, round(sum(value), 6) AS total FROM w GROUP BY 1, 2 HAVING count(*) = 12")
def i1_a21_stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_all(jobs.hop_windows(_events(spark, sf), "session", "n", "score", 12, 4), "windows")
    return out.select("session", "k", F.round(F.aggregate("signal", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {DECISIONS} SELECT session, count_if(score >= CASE WHEN session % 3 = 0 THEN 60.0 ELSE 20.0 END) AS passed FROM decisions GROUP BY 1", longs="passed")
def c14_stream_profiles(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").select(F.col("user_id").alias("session")).distinct().where("session % 3 = 0").withColumn("threshold", F.lit(60.0))
    out = jobs.run_all(jobs.with_profile(_events(spark, sf), users, 20.0), "gated")
    return out.groupBy("session").agg(F.count("command").alias("passed"))


# Live path: chained states, snapshots, pauses, rates

_HOUR = 3_600_000
_BACKLOG = {"most": 2, "every": 12 * _HOUR, "keep": 20 * _HOUR}


@query()
def i4_backpressure(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of windows whose consumer takes one every twelve hours: served, dropped (two wait at most) or too old."""
    return live.run_all(live.backpressure(_events(spark, sf), **_BACKLOG), "fates")


@query(
    f"{_MACHINE}, e AS (SELECT user_id AS session, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), c AS (SELECT m.session, event_id AS n, d.command, row_number() OVER (PARTITION BY m.session ORDER BY m.n) AS k FROM m JOIN decisions d USING (session, n) JOIN e USING (session, n) WHERE m.state = 'DISPATCHED'), "
    "sel AS (SELECT session, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS command, [0] AS lows, [5] AS sizes, CAST(NULL AS BIGINT) AS chosen FROM c WHERE k = 1 UNION ALL "
    "SELECT session, k, n, command, CASE WHEN s2 = 1 THEN [0] WHEN command = 'purchase' THEN l0 WHEN s2 IS NULL THEN lows ELSE list_append(lows, l2) END, CASE WHEN s2 = 1 THEN [5] WHEN command = 'purchase' THEN s0 WHEN s2 IS NULL THEN sizes ELSE list_append(sizes, s2) END, CASE WHEN s2 = 1 THEN l2 END FROM ("
    "SELECT c.session, c.k, c.n, c.command, lows, sizes, CASE WHEN len(lows) > 1 THEN lows[1:len(lows) - 1] ELSE lows END AS l0, CASE WHEN len(sizes) > 1 THEN sizes[1:len(sizes) - 1] ELSE sizes END AS s0, CASE c.command WHEN 'view' THEN lows[-1] WHEN 'click' THEN lows[-1] + (sizes[-1] + 1) // 2 END AS l2, CASE c.command WHEN 'view' THEN (sizes[-1] + 1) // 2 WHEN 'click' THEN sizes[-1] - (sizes[-1] + 1) // 2 END AS s2 FROM sel JOIN c ON c.session = sel.session AND c.k = sel.k + 1)) "
    "SELECT session, n, command, chosen FROM sel WHERE k > 0"
)
def k14_live_selections(spark: SparkSession, sf: str) -> DataFrame:
    """Windows to commands to selections in one stream: left and right halve five targets, purchase takes a step back."""
    out = live.selections(_events(spark, sf), 5, "view", "click", "purchase", run=2, lockout=60_000_000, refractory=90_000_000)
    return live.run_all(out, "selections").select("session", "n", "command", "chosen")


@query(f"WITH {DECISIONS} SELECT session, max(n) AS n, arg_max(predicted, n) AS predicted, arg_max(score, n) AS score FROM decisions GROUP BY 1".replace("row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n", "event_id AS n"))
def a11_versioned_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The newest window of each session, kept as a versioned table while the stream runs; read by its last pointer."""
    rows = _events(spark, sf).select("session", "n", "predicted", "score")
    path = scratch_path(spark, "snapshot")
    live.versioned(rows, path, f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return live.current(spark, path, rows.schema)


_QUIET = 6 * _HOUR
_KIND = "CASE event_type WHEN 'signup' THEN 'pause' WHEN 'purchase' THEN 'resume' WHEN 'click' THEN 'feedback' END"
#: Islands between pauses and resumes by running counts, and the gap after the last resume or feedback.
_PAUSES = (
    f"WITH k AS (SELECT user_id AS session, event_id AS n, epoch_us(ts) // 1000 AS t, {_KIND} AS kind FROM events), "
    "i AS (SELECT *, count(CASE WHEN kind IN ('pause', 'resume') THEN 1 END) OVER (PARTITION BY session ORDER BY n) AS island, max(CASE WHEN kind IN ('resume', 'feedback') THEN t END) OVER (PARTITION BY session ORDER BY n) AS since FROM k), "
    "s AS (SELECT *, first_value(kind) OVER (PARTITION BY session, island ORDER BY n) AS opened FROM i) "
    f"SELECT session, n, kind IS NULL AND (island = 0 OR opened <> 'pause') AND (since IS NULL OR t - since >= {_QUIET}) AS kept FROM s"
)


def _kind() -> Column:
    return F.when(F.col("predicted") == "signup", "pause").when(F.col("predicted") == "purchase", "resume").when(F.col("predicted") == "click", "feedback")


@query(_PAUSES)
def i9_pause_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Which windows count: none while paused, none for six hours after a resume or feedback."""
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("n"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), F.col("event_type").alias("predicted"))
    return live.suppressed(rows, ["session"], "n", "t_ms", _kind(), _QUIET).select("session", "n", "kept")


@query(_PAUSES)
def i9_pause_resume_stream(spark: SparkSession, sf: str) -> DataFrame:
    return live.run_all(live.suppressed_stream(_events(spark, sf).withColumn("kind", _kind()), _QUIET), "kept")


_CLOSED = "(SELECT max(ts) - INTERVAL 10 SECOND FROM events)"


@query(f"SELECT user_id AS session, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS slot, count(*) AS n FROM events GROUP BY 1, 2 HAVING slot + INTERVAL 1 DAY <= {_CLOSED}")
def i12_stream_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows a day of each session, of the days that the watermark has closed."""
    return jobs.run_all(jobs.rates(_events(spark, sf), every="1 day"), "rates").select("session", F.col("slot").cast("timestamp_ntz").alias("slot"), "n")


@query(f"SELECT user_id AS session, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS slot, arg_max(event_id, ts) AS n FROM events GROUP BY 1, 2 HAVING slot + INTERVAL 6 HOUR <= {_CLOSED}")
def i13_stream_throttle(spark: SparkSession, sf: str) -> DataFrame:
    """The newest window of each session in each six hours."""
    return jobs.run_all(jobs.throttled(_events(spark, sf), every="6 hours"), "throttled").select("session", F.col("slot").cast("timestamp_ntz").alias("slot"), "n")
