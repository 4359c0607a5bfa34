"""Sharing of features: consent as the latest state of a log of actions, who is due, and the export with its bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochflow.sources.scratch import staged

#: What people may log, and days between exports.
ENABLE, DISABLE, SYNC = "enable", "disable", "sync"
DAYS = 7


def consent(actions: DataFrame, user: str, at: str, order: str, action: str, days: int = DAYS) -> DataFrame:
    """(user, enabled, granted_at, last_sync, days): the state after a log of actions, in order of (at, order).

    A new grant forgets earlier exports. People who never granted have no row. Only maxima, so a user may log any number.
    """
    when = F.struct(F.col(at).alias("at"), F.col(order).alias("order"))
    latest = lambda kind: F.max(F.when(F.col(action) == kind, when))
    s = actions.groupBy(user).agg(latest(ENABLE).alias("_on"), latest(DISABLE).alias("_off"), latest(SYNC).alias("_sync")).where("_on IS NOT NULL")
    enabled = F.col("_off").isNull() | (F.col("_on") > F.col("_off"))
    return s.select(user, enabled.alias("enabled"), F.col("_on.at").alias("granted_at"), F.when(F.col("_sync") > F.col("_on"), F.col("_sync.at")).alias("last_sync"), F.lit(days).alias("days"))


def status(users: DataFrame, agreed: DataFrame, user: str, now: Column) -> DataFrame:
    """(user, status, next): not_enabled, not_due (next: when it will be) or due."""
    after = F.col("last_sync") + F.make_dt_interval(F.col("days"))
    on = F.coalesce(F.col("enabled"), F.lit(False))
    said = F.when(~on, "not_enabled").when(F.col("last_sync").isNull() | (now >= after), "due").otherwise("not_due")
    return users.select(user).join(agreed, user, "left").select(user, said.alias("status"), F.when(on & (now < after), after).alias("next"))


def sync(features: DataFrame, stated: DataFrame, user: str, path: str) -> DataFrame:
    """Writes the features (user, ...) of everyone who is due to `path`, overwriting what an earlier try left there.

    Returns (user, status, next, trials): due becomes exported, or no_data without a trial. Features alone are written, so
    no signal leaves; a try that is repeated gives the same files.
    """
    due = stated.where("status = 'due'").select(user)
    features.join(due, user, "left_semi").write.mode("overwrite").parquet(path)
    # Counted at once, so that the answer holds when a later try replaces the files.
    sent = staged(features.sparkSession.read.schema(features.schema).parquet(path).groupBy(user).agg(F.count(F.lit(1)).alias("trials")), "sent")
    out = stated.join(sent, user, "left")
    said = F.when(F.col("status") != "due", F.col("status")).when(F.col("trials") > 0, "exported").otherwise("no_data")
    return out.select(user, said.alias("status"), "next", F.coalesce("trials", F.lit(0)).alias("trials"))


def after_sync(agreed: DataFrame, result: DataFrame, user: str, now: Column) -> DataFrame:
    """The consent table with `now` as the last export of those who were exported."""
    sent = result.where("status = 'exported'").select(user, F.lit(True).alias("_sent"))
    return agreed.join(sent, user, "left").withColumn("last_sync", F.when(F.col("_sent"), now).otherwise(F.col("last_sync"))).drop("_sent")
