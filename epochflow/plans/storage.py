"""Tables written and read again: archives, logs, feature exports, model tables, the dataset registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochflow.functions import dims
from epochflow.operators import signals, spatial
from epochflow.plans.base import SIGNAL, epochs, query, signal, table
from epochflow.plans.live import _events
from epochflow.sources import archives, recordings
from epochflow.sources.scratch import scratch_path
from epochflow.streaming import jobs

_NAMES = "['" + "', '".join(d[0] for d in dims.DATASETS) + "']"
_REGISTRY = "reg(dataset, license, access, importer) AS (VALUES " + ", ".join(f"('{d[0]}', '{d[5]}', '{d[6]}', {repr(d[7]) if d[7] else 'NULL'})" for d in dims.DATASETS) + ")"


@query(f"WITH {_REGISTRY}, e AS (SELECT {_NAMES}[CAST(vec_id % {len(dims.DATASETS)} + 1 AS INT)] AS dataset FROM embeddings) SELECT dataset, any_value(license) AS license, count(*) AS trials FROM e JOIN reg USING (dataset) WHERE access = 'public' AND importer IS NOT NULL GROUP BY 1")
def a15_registry_gate(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(d[0]) for d in dims.DATASETS]), (F.col("epoch_id") % len(dims.DATASETS) + 1).cast("int"))
    open_ = dims.datasets(spark).where("access = 'public' and importer is not null")
    return epochs(spark, sf).select(name.alias("dataset")).join(F.broadcast(open_), "dataset").groupBy("dataset").agg(F.first("license").alias("license"), F.count(F.lit(1)).alias("trials"))


@query("SELECT CAST(vec_id % 5 AS VARCHAR) AS session, count(*) AS trials, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 4) AS total FROM embeddings WHERE vec_id % 10 IN (3, 8) GROUP BY 1")
def a1_a3_a6_archive_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All epochs as an archive by subject and session; two subjects are read, so only their folders are."""
    rows = epochs(spark, sf).select(
        F.col("epoch_id").cast("string"), F.col("subject").cast("string"), F.col("session").cast("string"), F.col("label").cast("string"), F.lit(250.0).alias("fs"), F.lit("cyton8_mi").alias("montage"), F.lit("uV").alias("units"), "signal"
    )
    path = scratch_path(spark, "archive")
    archives.write_archive(rows, path)
    total = F.aggregate(F.flatten("signal"), F.lit(0.0), lambda a, x: a + x)
    read = archives.read_archive(spark, path).where(F.col("subject").isin("3", "8"))
    return read.groupBy("session").agg(F.count(F.lit(1)).alias("trials"), F.round(F.sum(total), 4).alias("total"))


@query("SELECT user_id AS session, count(*) AS cues, count(*) FILTER (value >= 10) AS complied FROM events WHERE event_type = 'signup' GROUP BY 1")
def a8_a9_cue_log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Cue logs as CSV with a header by session, read again with empty fields as nulls."""
    cues = table(spark, sf, "events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("trial"), F.when(F.col("value") >= 10, F.col("value")).alias("clicked"))
    path = scratch_path(spark, "cues")
    cues.write.option("header", True).csv(path)
    back = spark.read.schema("user_id bigint, trial bigint, clicked double").option("header", True).csv(path)
    return back.groupBy(F.col("user_id").alias("session")).agg(F.count(F.lit(1)).alias("cues"), F.count("clicked").alias("complied"))


@query("SELECT user_id AS session, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def a10_event_log(spark: SparkSession, sf: str) -> DataFrame:
    """The live stream appended as JSON lines, read back with one schema for all kinds."""
    path = scratch_path(spark, "log")
    rows = _events(spark, sf).select("session", F.col("predicted").alias("kind"), "n")
    q = rows.writeStream.format("json").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    log = spark.read.schema("session bigint, kind string, n bigint").json(f"{path}/rows")
    return log.groupBy("session", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS session, count(*) AS windows FROM events GROUP BY 1")
def a11_a22_live_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts kept per session while the stream runs, as the last version of the table has them."""
    counts = _events(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("windows"))
    path = scratch_path(spark, "live")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")  # complete mode: each batch is the whole table

    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/rows")


@query(f"WITH {SIGNAL}, d AS (SELECT channel, i, x, round(i / 250.0, 6) AS t FROM signal WHERE channel = 'click') SELECT count(*) AS n, round(sum(x) * 2, 4) AS total, CAST(250 AS BIGINT) AS fs FROM d")
def a7_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """One channel's samples as a text table, read with names in another case, scaled, the rate inferred."""
    s = signal(spark, sf).where("channel = 'click'").select(F.round(F.col("i") / 250.0, 6).alias("Session_Time"), F.col("x").alias("C3"))
    path = scratch_path(spark, "csv")
    s.write.option("header", True).option("sep", ";").csv(path)
    rows = archives.read_continuous_csv(spark, path, "session_time", ["c3"], ";", 2.0)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"), F.round(F.max("fs")).cast("bigint").alias("fs"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"WITH {SIGNAL}, w AS (SELECT i, count(*) AS c FROM signal GROUP BY 1 HAVING count(*) = {len(_TYPES)}), n AS (SELECT count(*) AS n FROM w) SELECT channel, count(*) AS n, round(sum(x) * 1000, 3) AS total, round(sum(i * x), 3) AS moment, CAST(500 AS BIGINT) AS fs FROM signal SEMI JOIN w USING (i) GROUP BY 1")
def a7_csv_channels(spark: SparkSession, sf: str) -> DataFrame:
    """All channels as one text table: its separator is found, times are milliseconds, rows that lack a channel are dropped.

    moment weighs each sample by its place, so samples out of order would show.
    """
    wide = signal(spark, sf).groupBy("i").agg(*[F.max(F.when(F.col("channel") == c, F.col("x"))).alias(c.upper()) for c in _TYPES])
    path = scratch_path(spark, "csv")
    wide.select((F.col("i") * 2.0).alias("Time"), *[c.upper() for c in _TYPES]).write.option("header", True).option("sep", "\t").csv(path)
    rows = archives.read_continuous_csv(spark, path, "time", list(_TYPES), scale=1000.0)
    return rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("total"), F.round(F.sum(F.col("i") * F.col("x") / 1000), 3).alias("moment"), F.round(F.max("fs")).cast("bigint").alias("fs"))


@query()
def a16_k15_feature_export(spark: SparkSession, sf: str) -> DataFrame:
    """Tangent vectors as floats with small class numbers; no raw signal leaves."""
    c = epochs(spark, sf).select("subject", "label", signals.covariance(F.col("signal")).alias("cov"))
    rows = spatial.tangent_features(c, spatial.frechet_mean(c)).select("subject", F.col("label").cast("tinyint").alias("class"), F.transform("features", lambda x: x.cast("float")).alias("features"))
    path = scratch_path(spark, "export")
    rows.write.partitionBy("subject").parquet(path)
    return spark.read.parquet(path)


@query()
def a19_model_table(spark: SparkSession, sf: str) -> DataFrame:
    """Spatial filters kept in a model table, loaded by kind (exactly one), and used."""
    c = epochs(spark, sf).where("label in (0, 1)").select("epoch_id", "label", "signal", signals.covariance(F.col("signal")).alias("cov"))
    w = spatial.csp_filters(c, "label", (0, 1))
    path = scratch_path(spark, "models")
    spark.createDataFrame([("csp", 1, [float(x) for x in w.ravel()], len(w))], "kind string, version int, params array<double>, rows int").write.parquet(path)
    found = spark.read.parquet(path).where("kind = 'csp'").limit(2).collect()
    if len(found) != 1:
        raise ValueError("expected one model of this kind")
    import numpy as np

    return spatial.csp_features(c, np.array(found[0]["params"]).reshape(found[0]["rows"], -1)).select("epoch_id", "features")


@query()
def i8_dwell(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that stayed armed for an hour of event time, over the live stream."""
    rows = _events(spark, sf).select("ts", "session", F.when(F.col("predicted") != "error", F.col("predicted")).alias("target"))
    return jobs.run_all(jobs.dwell(rows, 3600.0, "1 hour"), "dwell")


def _recorded(spark: SparkSession, sf: str) -> str:
    """The folder of the epochs' recordings, one a subject and session."""
    path = scratch_path(spark, "recordings")
    rows = epochs(spark, sf).withColumns({"name": F.when(F.col("label") < 2, F.lit("idle_rest")).otherwise(F.concat(F.lit("target_"), F.col("label"))), "block": F.floor(F.col("epoch_id") / 50).cast("int")})
    recordings.write_recordings(rows, path, "subject", "session", "epoch_id", "name", block="block").agg(F.sum("trials")).collect()  # one row
    spark.dataSource.register(recordings.Recordings)
    return path


_RECORDED = "SELECT CAST(vec_id % 10 AS VARCHAR) AS subject, CAST(vec_id % 5 AS VARCHAR) AS session, count(*) AS trials, count(DISTINCT vec_id // 50) AS blocks, count_if(label < 2) AS idle, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 4) AS total FROM embeddings {} GROUP BY 1, 2"


def _summary(rows: DataFrame) -> DataFrame:
    total = F.aggregate(F.flatten("signal"), F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("subject", "session").agg(F.count(F.lit(1)).alias("trials"), F.count_distinct("block").alias("blocks"), F.count_if("idle").alias("idle"), F.round(F.sum(total), 4).alias("total"))


@query(_RECORDED.format("WHERE vec_id % 10 IN (3, 8)"), longs="idle")
def a1_recording_source(spark: SparkSession, sf: str) -> DataFrame:
    """All sessions of two subjects through the data source, with blocks and the idle set; files of others are not opened."""
    return _summary(spark.read.format("recording").option("path", _recorded(spark, sf)).option("subjects", "3,8").load())


@query(_RECORDED.format(""), longs="idle")
def a22_recording_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same files as a stream."""
    return _summary(jobs.run_all(spark.readStream.format("recording").option("path", _recorded(spark, sf)).load(), "recorded"))
