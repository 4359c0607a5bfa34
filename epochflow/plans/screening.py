"""Reliability, compliance, preflight and archives as users meet them: reasons and verdicts beside the numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochflow.functions import kernels as K
from epochflow.operators import quality, signals, stats, windows
from epochflow.plans.base import EPOCHS, epochs, long_epochs, query, table
from epochflow.plans.streams import _LIMITS, _STATS, _channel_stats, _screened
from epochflow.sources import standard
from epochflow.sources.scratch import scratch_path


@query("WITH e AS (SELECT vec_id // 50 AS person, label % 2 AS y, vec_id // 10 AS block, vec_id % 3 AS session FROM embeddings), c AS (SELECT person, y, count(*) AS trials, count(DISTINCT block) AS blocks FROM e GROUP BY 1, 2), s AS (SELECT person, count(DISTINCT session) AS sessions FROM e GROUP BY 1), m AS (SELECT person, count(*) AS classes, min(trials) AS least_trials, min(blocks) AS least_blocks, any_value(sessions) AS sessions FROM c JOIN s USING (person) GROUP BY 1) SELECT person, classes, least_trials, least_blocks, sessions, CASE WHEN classes < 2 OR least_trials < 25 THEN 'NOT_ENOUGH' WHEN least_blocks < 5 THEN 'NOT_TRUSTWORTHY' WHEN sessions < 3 THEN 'PROVISIONAL' ELSE 'RELIABLE' END AS verdict FROM m")
def d34_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a person's cross-validation can be trusted; the limits are those that tell these tables' people apart."""
    e = epochs(spark, sf).select(F.floor(F.col("epoch_id") / 50).alias("person"), (F.col("label") % 2).alias("y"), F.floor(F.col("epoch_id") / 10).alias("block"), (F.col("epoch_id") % 3).alias("session"))
    return stats.reliability(e, ["person"], "y", "block", "session", trials=25, blocks=5)


_FLAGS = "(amplitude OR flat OR jump OR outlier)"


@query(f"{_STATS}, n AS (SELECT subject, count_if(NOT {_FLAGS}) AS kept, greatest(100, 2 * count(DISTINCT label)) AS least FROM scr GROUP BY 1) SELECT subject, count(*) AS used FROM scr JOIN n USING (subject) WHERE NOT {_FLAGS} OR kept < least GROUP BY 1")
def b7_mask_by_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The screening holds only for people who keep enough trials: a least number, and two of each class."""
    return quality.masked_by_classes(_screened(spark, sf), ["subject"], "label", least=100).groupBy("subject").agg(F.count(F.lit(1)).alias("used"))


@query(
    f"{_STATS}, o AS (SELECT scr.*, epoch_id % 10 = 3 OR epoch_id % 4 = subject % 4 AND subject > 5 AS noncompliant FROM scr), r AS (SELECT subject, count(*) AS trials, count_if(NOT {_FLAGS} AND NOT noncompliant) AS kept, count_if(noncompliant) AS n FROM o GROUP BY 1) "
    "SELECT subject, trials, kept, round(1 - kept / trials, 6) AS drop_rate, round(n / trials, 6) AS noncompliant_rate, concat_ws('; ', CASE WHEN 1 - kept / trials > 0.33 THEN 'many trials dropped' END, CASE WHEN n / trials > 0.25 THEN 'cues often not followed' END) AS warnings FROM r",
    longs="kept",
)
def d3_compliance_report(spark: SparkSession, sf: str) -> DataFrame:
    """Screening with what the cue log says about each trial folded in, and a report with its warnings."""
    off = (F.col("epoch_id") % 10 == 3) | ((F.col("epoch_id") % 4 == F.col("subject") % 4) & (F.col("subject") > 5))
    screened = quality.screen(_channel_stats(spark, sf), ["epoch_id", "subject"], "label", _LIMITS, noncompliant=off)
    out = quality.compliance_report(screened, ["subject"])
    return out.withColumns({"drop_rate": F.round("drop_rate", 6), "noncompliant_rate": F.round("noncompliant_rate", 6), "warnings": F.array_join("warnings", "; ")})


@query("WITH c AS (SELECT user_id AS session, event_id, ts, value, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events) SELECT session, event_id, CASE WHEN value >= 100 THEN CAST(floor(value) AS BIGINT) ELSE CAST(trunc((epoch_us(ts) // 1000 - epoch_us(t0) // 1000) / 1000.0::DOUBLE * 250.0::DOUBLE) AS BIGINT) END AS sample FROM c WHERE session IS NOT NULL")
def c2_cue_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The sample of each cue: what the log says (a value of 100 or more stands for it), else from its time and the rate."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.when(F.col("value") >= 100, F.floor("value")).alias("cue_sample"))
    start = e.groupBy("session").agg(F.min("ms").alias("t0"))
    return e.join(start, "session").select("session", "event_id", windows.cue_sample(F.col("cue_sample"), F.col("ms"), F.col("t0"), 250.0).alias("sample"))


_TONES = [(7.5, "left"), (10.0, "right"), (12.0, "select"), (15.0, "undo")]


@query("WITH m(hz, command) AS (VALUES (7.5, 'left'), (10.0, 'right'), (12.0, 'select'), (15.0, 'undo')), t AS (SELECT event_id, value / 10.0 AS hz, (event_id % 40) / 1.0 AS snr FROM events), j AS (SELECT t.event_id, arg_min(m.command, (abs(t.hz - m.hz), m.hz)) AS command FROM t JOIN m ON abs(t.hz - m.hz) <= 0.6 GROUP BY 1) SELECT t.event_id, CASE WHEN snr >= 5 THEN command END AS command, round(CASE WHEN snr >= 5 AND command IS NOT NULL THEN least(1, snr / 20) ELSE 0 END, 6) AS confidence FROM t LEFT JOIN j USING (event_id)")
def h14_tone_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Tones to commands: the nearest within a tolerance, with a confidence from the tone's strength."""
    t = table(spark, sf, "events").select("event_id", (F.col("value") / 10.0).alias("hz"), (F.col("event_id") % 40).cast("double").alias("snr"))
    out = t.select("event_id", *signals.tone_command(F.col("hz"), F.col("snr"), _TONES, tolerance=0.6, least_snr=5.0))
    return out.withColumn("confidence", F.round("confidence", 6))


@query("WITH g AS (SELECT vec_id % 10 AS subject, vec_id // 100 % 5 AS fold, label FROM embeddings WHERE label < 2 AND (vec_id // 100 % 5 <> 3 OR label = 0)), c AS (SELECT fold, label, count(*) AS n FROM g GROUP BY 1, 2), f AS (SELECT fold, count(*) AS inside FROM c GROUP BY 1), o AS (SELECT f.fold, count(DISTINCT c.label) AS outside FROM f JOIN c ON c.fold <> f.fold GROUP BY 1) SELECT fold FROM f JOIN o USING (fold) WHERE inside >= 2 AND outside >= 2")
def e8_usable_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Folds that have both classes on either side; one of the five lacks a class and is skipped."""
    e = epochs(spark, sf).select("label", (F.floor(F.col("epoch_id") / 100) % 5).alias("fold")).where("label < 2 AND (fold <> 3 OR label = 0)")
    return windows.usable_folds(e, "label")


_SUMS = "sum(CASE WHEN bin IN (0, 4) THEN 1 ELSE 4 END * (re * re + im * im) / 64)"


@query(f"WITH {EPOCHS}, b AS (SELECT epoch_id, ch, k AS bin, sum(x * cos(2 * pi() * ((k * s) % 8) / 8)) AS re, sum(x * sin(2 * pi() * ((k * s) % 8) / 8)) AS im FROM epochs, range(5) t(k) GROUP BY 1, 2, 3), bands(band, low, high) AS (VALUES ('alpha', 8, 13), ('beta', 13, 30), ('gamma', 30, 45), ('broad', 1, 40)), p AS (SELECT epoch_id, ch, band, {_SUMS} AS power FROM b JOIN bands ON bin * 10.0 BETWEEN low AND high GROUP BY 1, 2, 3) SELECT ch, band, round(quantile_cont(power, 0.5), 6) AS median_power, count(*) AS epochs FROM p GROUP BY 1, 2")
def d20_band_table(spark: SparkSession, sf: str) -> DataFrame:
    """Median power of each channel in each named band that a bin of these short epochs (read at 80 Hz) falls in."""
    s = signals.spectrum(long_epochs(spark, sf), ["epoch_id", "ch"], "s", "x", 8, 80.0)
    return signals.band_table(s, ["epoch_id", "ch"], K.BANDS).select("ch", "band", F.round("median_power", 6).alias("median_power"), F.col("n").alias("epochs"))


@query("WITH c AS (SELECT user_id AS session, event_type AS channel, count(*) AS n, count_if(isnan(value) OR value IS NULL OR isinf(value)) AS bad, stddev_pop(value) AS sd, count(DISTINCT value) AS distinct_values, max(abs(value)) AS peak FROM events GROUP BY 1, 2), r AS (SELECT session, channel, CASE WHEN bad > 0 THEN 'not finite' WHEN sd < 1.0 THEN 'dead' WHEN distinct_values < 10 THEN 'stuck' WHEN sd > 200.0 THEN 'saturated' WHEN peak > 60.0 AND sd > 15.0 THEN 'large' END AS reason FROM c), s AS (SELECT session, count(*) AS channels, count(reason) AS flagged, count_if(reason = 'large') AS large, string_agg(channel || ': ' || reason, '; ' ORDER BY channel) AS reasons FROM r GROUP BY 1) SELECT session, channels, flagged, coalesce(reasons, '') AS reasons, CASE WHEN flagged = 0 THEN 'READY' WHEN large = channels THEN 'CHECK_REFERENCE' ELSE 'BLOCKED' END AS verdict FROM s")
def d18_preflight_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """A reason for each channel that is not fit, and a verdict that tells a bad reference (all channels large) from bad channels."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("channel"), F.col("value").alias("x"))
    return quality.preflight_reasons(e, ["session"], "channel", "x", large=60.0, least_spread=15.0)


# Archives

_CHANNELS = ("Fp1", "Fp2", "C3", "CZ", "C4", "CP3", "CP4", "PZ")
_HEADER = standard.Header("cho2017", "hand", _CHANNELS, 8, 250.0, "uV", "imagery", (("left", "left_hand"), ("right", "right_hand"), ("rest", "idle")))


def _standard_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = epochs(spark, sf)
    source = F.element_at(F.array(*map(F.lit, ("left", "right", "rest"))), (F.col("label") % 3 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("left_hand", "right_hand", "idle"))), (F.col("label") % 3 + 1).cast("int"))
    return e.select(F.col("epoch_id").cast("string"), F.col("subject").cast("string"), F.col("session").cast("string"), name.alias("label"), source.alias("source_label"), "signal")


@query("SELECT 'cho2017:' || (vec_id % 10) AS subject, ['left_hand', 'right_hand', 'idle'][label % 3 + 1] AS label, count(*) AS trials, count(DISTINCT vec_id % 5) AS sessions FROM embeddings GROUP BY 1, 2")
def a12_g1_standard_archives(spark: SparkSession, sf: str) -> DataFrame:
    """Two archives written, checked as they are written, published, read and checked again, and put together."""
    path = scratch_path(spark, "standard")
    rows = _standard_rows(spark, sf)
    for k in range(2):
        standard.write_archive(rows.where(F.col("epoch_id").cast("bigint") % 2 == k), _HEADER, f"{path}/{k}")
    both = standard.union_archives(spark, [f"{path}/{k}" for k in range(2)])
    return both.groupBy("subject", "label").agg(F.count(F.lit(1)).alias("trials"), F.count_distinct("session").alias("sessions"))


def _dirty(rows: DataFrame) -> DataFrame:
    k: Column = F.col("epoch_id").cast("bigint")
    return rows.withColumns(
        {
            "signal": F.when(k % 50 == 1, F.slice("signal", 1, 7)).when(k % 50 == 2, F.transform("signal", lambda c: F.transform(c, lambda x: F.lit(float("nan"))))).otherwise(F.col("signal")),
            "subject": F.when(k % 50 != 3, F.col("subject")),
            "session": F.when(k % 50 != 4, F.col("session")),
            "label": F.when(k % 50 == 5, F.lit("left_foot")).when(k % 50 == 6, F.lit("tail")).when(k % 50 != 7, F.col("label")),
        }
    )


@query("WITH k AS (SELECT vec_id % 50 AS k FROM embeddings) SELECT unnest(['signal is not channels x samples', 'signal is not finite', 'subject is missing', 'session is missing', 'label is missing', 'label is not canonical', 'label is of another category', 'labels are not a pair of the registry''s mapping']) AS rule, unnest([count_if(k = 1), count_if(k = 2), count_if(k = 3), count_if(k = 4), count_if(k = 7), count_if(k IN (6, 7)), count_if(k = 5), count_if(k IN (5, 6, 7))]) AS trials FROM k", longs="trials")
def a12_a13_rule_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many trials of a damaged archive break each rule, in one scan."""
    return standard.rule_counts(_dirty(_standard_rows(spark, sf)), _HEADER)
