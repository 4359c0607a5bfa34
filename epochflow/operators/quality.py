"""Screening of trials and recordings. Everything here is DataFrame expressions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochflow.functions.columns import log_variance, reasons
from epochflow.operators.stats import exact_quantile
from epochflow.sources.scratch import staged

# Screening limits (microvolts; robust z), and shares of a recording.
LIMITS = {"amplitude": 400.0, "flat": 0.05, "jump": 75.0, "outlier": 4.0}
MOST_DROPPED, MOST_NONCOMPLIANT = 0.33, 0.25
# Hardware tiers (microvolts RMS) and least distinct values.
DEAD, NOISY, SATURATED, STUCK = 1.0, 100.0, 200.0, 10


def signal_stats(signal: Column) -> list[Column]:
    """peak (of the mean-centred signal), std (population) and jump (largest step) of an array of samples."""
    mean = F.aggregate(signal, F.lit(0.0), lambda a, x: a + x) / F.size(signal)
    # The mean is bound by a transform of one element, or it would be computed anew for each sample.
    square = F.transform(F.array(mean), lambda m: F.aggregate(signal, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))[0]
    peak = F.transform(F.array(mean), lambda m: F.greatest(F.abs(F.array_max(signal) - m), F.abs(F.array_min(signal) - m)))[0]
    steps = F.zip_with(F.slice(signal, 2, 1 << 30), F.slice(signal, 1, F.size(signal) - 1), lambda b, a: F.abs(b - a))
    return [peak.alias("peak"), F.sqrt(square / F.size(signal)).alias("std"), F.coalesce(F.array_max(steps), F.lit(0.0)).alias("jump")]


def long_stats(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The same for one row per sample."""
    w = Window.partitionBy(*keys)
    step = F.abs(F.col(value) - F.lag(value).over(w.orderBy(order)))
    out = df.withColumn("_d", F.abs(F.col(value) - F.avg(value).over(w))).withColumn("_j", step)
    return out.groupBy(*keys).agg(F.max("_d").alias("peak"), F.stddev_pop(value).alias("std"), F.coalesce(F.max("_j"), F.lit(0.0)).alias("jump"), F.count(F.lit(1)).alias("n"))


def robust_z(df: DataFrame, keys: list[str], value: str, out: str = "z", least: int = 0) -> DataFrame:
    """Adds 0.6745 (v - median) / MAD within each key; 0 where the MAD is 0 or the key has fewer than `least` rows.

    Both medians are exact and come from brackets, so a key may hold any share of the rows.
    """
    rows = staged(df, "scores")  # read for both medians and for the result
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    middle = lambda d, c, name: exact_quantile(d, keys, c, [0.5]).select(*keys, F.col("quantiles")[0].alias(name))
    mid = staged(n.join(middle(rows, value, "_m"), keys, "left"), "medians")
    off = rows.join(mid, keys).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    z = F.when((F.col("_mad") > 0) & (F.col("_n") >= least), 0.6745 * (F.col(value) - F.col("_m")) / F.col("_mad")).otherwise(0.0)
    return off.join(middle(off, "_d", "_mad"), keys, "left").withColumn(out, z).drop("_m", "_n", "_d", "_mad")


def screen(stats: DataFrame, trial: list[str], label: str, limits: dict | None = None, noncompliant: Column | None = None) -> DataFrame:
    """One row per trial from one row per (trial, channel) with peak, std, jump: reasons, keep, failing channels.

    Reasons are independent flags; the outlier flag compares log power with the channel's trials of the same class, in
    classes of four trials or more.
    """
    top = {**LIMITS, **(limits or {})}
    scored = robust_z(stats.withColumn("_p", log_variance(F.col("std") * F.col("std"))), [label, "channel"], "_p", "_z", 4)
    flags = {
        "amplitude": F.col("peak") > top["amplitude"],
        "flat": F.col("std") < top["flat"],
        "jump": F.col("jump") > top["jump"],
        "outlier": F.abs("_z") > top["outlier"],
    }
    failing = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("channel"))))
    bad = noncompliant if noncompliant is not None else F.lit(False)
    out = scored.groupBy(*trial, label).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()], *[failing(c).alias(f"{n}_channels") for n, c in flags.items()], F.bool_or(bad).alias("noncompliant"))
    out = out.withColumn("reasons", reasons(*[(F.col(n), n) for n in (*flags, "noncompliant")]))
    return out.withColumn("keep", F.size("reasons") == 0)


def recording_verdict(screened: DataFrame, keys: list[str]) -> DataFrame:
    """trials, kept, drop rate and the verdict of each recording, with the first rejecting step."""
    steps = ["amplitude", "flat", "jump", "outlier", "noncompliant"]
    out = screened.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), F.count_if("keep").alias("kept"), *[F.count_if(s).alias(f"n_{s}") for s in steps])
    rate = 1 - F.col("kept") / F.col("trials")
    first = F.array_min(F.filter(F.array(*[F.when(F.col(f"n_{s}") > 0, F.lit(i)) for i, s in enumerate(steps)]), lambda x: x.isNotNull()))
    return out.withColumns({"drop_rate": rate, "first_reason": F.when(first.isNotNull(), F.element_at(F.array(*map(F.lit, steps)), first + 1)), "verdict": F.when((F.col("kept") > 0) & (rate <= MOST_DROPPED), "ACCEPT").otherwise("REJECT")})


def masked_if_enough(screened: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """The kept trials of each key, or all of them where fewer than `least` were kept."""
    n = screened.groupBy(*keys).agg(F.count_if("keep").alias("_n"))
    return screened.join(n, keys).where((F.col("_n") < least) | F.col("keep")).drop("_n")


def masked_by_classes(screened: DataFrame, keys: list[str], label: str, least: int = 8, each: int = 2) -> DataFrame:
    """The kept trials of each key, or all of them where fewer than the larger of `least` and `each` a class were kept.

    Counts are joined back, a row a key, so no key's trials meet in one task.
    """
    n = screened.groupBy(*keys).agg(F.count_if("keep").alias("_n"), F.greatest(F.lit(least), each * F.count_distinct(label)).alias("_least"))
    return screened.join(n, keys).where(F.col("keep") | (F.col("_n") < F.col("_least"))).drop("_n", "_least")


def compliance_report(screened: DataFrame, keys: list[str]) -> DataFrame:
    """trials, kept, drop rate and share of cues not followed of each key, with warnings where either is high."""
    out = screened.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), F.count_if("keep").alias("kept"), F.count_if("noncompliant").alias("_off"))
    out = out.withColumns({"drop_rate": 1 - F.col("kept") / F.col("trials"), "noncompliant_rate": F.col("_off") / F.col("trials")}).drop("_off")
    return out.withColumn("warnings", reasons((F.col("drop_rate") > MOST_DROPPED, "many trials dropped"), (F.col("noncompliant_rate") > MOST_NONCOMPLIANT, "cues often not followed")))


def preflight_reasons(df: DataFrame, keys: list[str], channel: str, value: str, large: float = 400.0, least_spread: float = 0.0) -> DataFrame:
    """channels, flagged, reasons and verdict of each session, from one row a sample.

    A channel is not finite, dead, stuck or saturated, or large: beyond `large` with more spread than least_spread. If all
    channels are large, it is the reference that is off: CHECK_REFERENCE; else a flagged channel blocks.
    """
    x = F.col(value)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    c = df.groupBy(*keys, channel).agg(F.count_if(bad).alias("bad"), F.stddev_pop(value).alias("sd"), F.count_distinct(value).alias("values"), F.max(F.abs(value)).alias("peak"))
    tier = hardware_tier(F.col("sd"), F.col("values"))
    reason = F.when(F.col("bad") > 0, "not finite").when(tier.isin("dead", "stuck", "saturated"), tier).when((F.col("peak") > large) & (F.col("sd") > least_spread), "large")
    named = F.when(F.col("reason").isNotNull(), F.struct(channel, "reason"))
    out = c.withColumn("reason", reason).groupBy(*keys).agg(F.count(F.lit(1)).alias("channels"), F.count("reason").alias("flagged"), F.count_if(F.col("reason") == "large").alias("_large"), F.sort_array(F.collect_list(named)).alias("_r"))
    said = F.array_join(F.transform("_r", lambda r: F.concat_ws(": ", r[channel], r["reason"])), "; ")
    verdict = F.when(F.col("flagged") == 0, "READY").when(F.col("_large") == F.col("channels"), "CHECK_REFERENCE").otherwise("BLOCKED")
    return out.select(*keys, "channels", "flagged", said.alias("reasons"), verdict.alias("verdict"))


def hardware_tier(std: Column, distinct: Column) -> Column:
    """dead, stuck, saturated, noisy or ok."""
    return F.when(std < DEAD, "dead").when(distinct < STUCK, "stuck").when(std > SATURATED, "saturated").when(std > NOISY, "noisy").otherwise("ok")


def gates(stages: DataFrame, keys: list[str], order: str, status: str) -> DataFrame:
    """Adds gated: SKIP below a stage that failed, else the stage's own status; and the first failing stage."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.max(F.col(status) == "FAIL").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    first = F.min(F.when(F.col(status) == "FAIL", F.col(order))).over(Window.partitionBy(*keys))
    return stages.withColumn("gated", F.when(before, "SKIP").otherwise(F.col(status))).withColumn("first_fail", first)


def json_reports(stages: DataFrame, keys: list[str], order: str, name: str, status: str, details: str) -> DataFrame:
    """(keys, report): one JSON object a key with its stages in order, a failed one's followers as SKIP, and the first failure.

    details is a struct of any fields; what is null is written as null. A key's stages are a few.
    """
    gated = gates(stages, keys, order, status)
    stage = F.struct(F.col(order).alias("_o"), F.struct(F.col(name).alias("name"), F.col("gated").alias("status"), F.col(details).alias("details")).alias("s"))
    first = F.max(F.when(F.col(order) == F.col("first_fail"), F.col(name)))
    out = gated.groupBy(*keys).agg(first.alias("first_failure"), F.transform(F.array_sort(F.collect_list(stage), lambda a, b: F.when(a["_o"] < b["_o"], -1).otherwise(1)), lambda x: x["s"]).alias("stages"))
    return out.select(*keys, F.to_json(F.struct(*keys, "first_failure", "stages"), {"ignoreNullFields": "false"}).alias("report"))


def preflight(stats: DataFrame, keys: list[str], rate: Column, nominal: float, tolerance: float = 0.15) -> DataFrame:
    """READY or BLOCKED for each session of one row per channel (std, distinct): rate error and channel tiers."""
    tier = hardware_tier(F.col("std"), F.col("distinct_values"))
    out = stats.withColumn("tier", tier).groupBy(*keys).agg(F.count_if(F.col("tier").isin("dead", "stuck", "saturated")).alias("bad"), F.count(F.lit(1)).alias("channels"), F.max(F.abs(rate / nominal - 1)).alias("rate_error"))
    return out.withColumn("verdict", F.when((F.col("bad") == 0) & (F.col("rate_error") <= tolerance), "READY").otherwise("BLOCKED"))
