"""Registration of queries, and the views of the given tables that they stand on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochflow.operators import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, longs: str = ""):
    """Registers a function (spark, sf_dir) under its name, with its SQL; `longs` names sums that SQL makes wider."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            cast = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in longs.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({cast}) FROM ({sql})" if longs else sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of samples per channel: channel, i, x, user_id, event_id."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("channel"), F.col("value").alias("x"), "user_id", "event_id")
    return windows.sample_index(e, ["channel"], "event_id").select("channel", "i", "x", "user_id", "event_id")


SIGNAL = "signal AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value AS x, user_id, event_id FROM events)"


def decisions(spark: SparkSession, sf: str, threshold: float = 10.0) -> DataFrame:
    """Window predictions per session: session, n, t_ms, command (null below the threshold), score, predicted, is_artifact."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("session"),
        F.row_number().over(w).cast("bigint").alias("n"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"),
        F.when(F.col("value") >= threshold, F.col("event_type")).alias("command"),
        F.col("event_type").alias("predicted"),
        F.col("value").alias("score"),
        (F.col("event_type") == "error").alias("is_artifact"),
    )


DECISIONS = "decisions AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, epoch_us(ts) // 1000 AS t_ms, CASE WHEN value >= 10.0 THEN event_type END AS command, event_type AS predicted, value AS score, event_type = 'error' AS is_artifact FROM events)"


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Trials of 8 channels x 8 samples: epoch_id, label, session, subject, signal."""
    e = table(spark, sf, "embeddings")
    channels = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.transform(F.slice("embedding", c * 8 + 1, 8), lambda x: x.cast("double")))
    return e.select(F.col("vec_id").alias("epoch_id"), "label", (F.col("vec_id") % 5).alias("session"), (F.col("vec_id") % 10).alias("subject"), channels.alias("signal"))


#: One row per sample: epoch_id, label, session, subject, ch, s, x.
EPOCHS = "epochs AS (SELECT vec_id AS epoch_id, label, vec_id % 5 AS session, vec_id % 10 AS subject, CAST(t.k // 8 AS INT) AS ch, CAST(t.k % 8 AS INT) AS s, CAST(embedding[t.k + 1] AS DOUBLE) AS x FROM embeddings, range(64) t(k))"


def long_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """The same, one row per sample."""
    rows = epochs(spark, sf).select("epoch_id", "label", "session", "subject", F.posexplode("signal").alias("ch", "row"))
    return rows.select("epoch_id", "label", "session", "subject", "ch", F.posexplode("row").alias("s", "x"))


def stream_windows(spark: SparkSession, sf: str, size: int = 750, hop: int = 250, channels: int = 5) -> DataFrame:
    """Windows of the stream over all its channels: epoch_id (the window's number), signal (channels by name)."""
    w = windows.hop_windows(signal(spark, sf), ["channel"], "i", "x", size, hop)
    rows = w.groupBy(F.col("k").alias("epoch_id")).agg(F.sort_array(F.collect_list(F.struct("channel", "signal"))).alias("c"))
    return rows.where(F.size("c") == channels).select("epoch_id", F.transform("c", lambda c: c["signal"]).alias("signal"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Values that are sums of doubles, rounded for comparison."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
