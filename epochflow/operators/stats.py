"""Statistics of scores, thresholds and models."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochflow.functions.columns import itr_bits
from epochflow.operators.windows import is_fired, run_start


def exact_quantile(df: DataFrame, keys: list[str], value: str, shares: list[float], out: str = "quantiles", error: float = 1e-3) -> DataFrame:
    """(keys, out): the linearly interpolated quantiles of each key, exact, whatever the rows of a key.

    A sketch brackets each quantile; rows below the bracket are counted, and only the distinct values within it are put in
    order, with how often they occur: ties, of which a bracket holds all, are counted before they meet in a task.
    """
    n = len(shares)
    given = [c for c in (*keys,)]
    near = [min(1.0, max(0.0, s + d)) for s in shares for d in (-error, error)]
    brackets = df.groupBy(*given).agg(F.percentile_approx(value, near, int(4 / error)).alias("_b"), F.count(value).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    each = brackets.select(
        *given, "_n", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(s).alias("share"), (F.lit(s) * (F.col("_n") - 1)).alias("at"), (F.col("_min") if near[2 * j] <= 0 else F.col("_b")[2 * j]).alias("low"), (F.col("_max") if near[2 * j + 1] >= 1 else F.col("_b")[2 * j + 1]).alias("high")) for j, s in enumerate(shares)])).alias("q")
    ).select(*given, "q.*")
    rows = df.where(F.col(value).isNotNull()).select(*given, F.col(value).cast("double").alias("_v"))
    rows = rows.join(each, given) if given else rows.crossJoin(F.broadcast(each))  # a row a quantile
    side = F.when(F.col("_v") < F.col("low"), 0).when(F.col("_v") > F.col("high"), 2).otherwise(1)
    # Rows below and above a bracket fold into one cell each before they are shuffled; those within it into one a value.
    cells = rows.select(*given, "j", "at", "_v", side.alias("_side")).groupBy(*given, "j", "at", "_side", F.when(F.col("_side") == 1, F.col("_v")).alias("_own"))
    cells = cells.agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    until = F.sum("_c").over(Window.partitionBy(*given, "j").orderBy("_side", "_own").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # A bracket may lack one of the two neighbours of a quantile; these are the largest value below it or the least above.
    nearest = F.when(F.col("_side") == 0, F.col("_most")).otherwise(F.col("_least"))
    of = lambda edge: F.min(F.when((F.col("_until") - F.col("_c") <= edge) & (edge < F.col("_until")), nearest))
    ends = cells.withColumn("_until", until).groupBy(*given, "j", "at").agg(of(F.floor("at")).alias("a"), of(F.ceil("at")).alias("z"))
    found = ends.select(*given, F.struct("j", (F.col("a") + (F.col("z") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("v")).alias("q"))
    return found.groupBy(*given).agg(F.transform(F.array_sort(F.collect_list("q")), lambda q: q["v"]).alias(out)).where(F.size(out) == n)


def idle_threshold(df: DataFrame, keys: list[str], score: str, idle: str, artifact: str, share: float = 0.95) -> DataFrame:
    """The share-quantile of idle scores without artifacts; keys without any are left out."""
    clean = df.where(F.col(idle) & ~F.col(artifact))
    return exact_quantile(clean, keys, score, [share]).select(*keys, F.col("quantiles")[0].alias("threshold"))


def cohen_d(m1: Column, v1: Column, m0: Column, v0: Column) -> Column:
    """Difference of means over the root of the mean of both population variances; 0 without spread."""
    pooled = F.sqrt((v0 + v1) / 2)
    return F.when(pooled > 0, (m1 - m0) / pooled).otherwise(0.0)


def separation(df: DataFrame, keys: list[str], score: str, active: str) -> DataFrame:
    """Means, spreads, 5 % and 95 % quantiles of active and idle scores, and Cohen's d."""
    of = lambda c, a: F.when(F.col(active) == a, F.col(c))
    names = ((True, "on"), (False, "off"))
    aggs = [x for a, n in names for x in (F.avg(of(score, a)).alias(f"mean_{n}"), F.stddev_pop(of(score, a)).alias(f"sd_{n}"))]
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    for a, n in names:
        edges = exact_quantile(df.where(F.col(active) == a), keys, score, [0.05, 0.95]).select(*keys, F.col("quantiles")[0].alias(f"p05_{n}"), F.col("quantiles")[1].alias(f"p95_{n}"))
        out = out.join(edges, keys, "left") if keys else out.join(F.broadcast(edges), F.lit(True), "left")  # one row each
    d = cohen_d(F.col("mean_on"), F.col("sd_on") ** 2, F.col("mean_off"), F.col("sd_off") ** 2)
    return out.withColumn("d", d)


def threshold_sweep(df: DataFrame, thresholds: DataFrame, order: str, hop_seconds: float, run: int = 3) -> DataFrame:
    """Metrics of debounced commands at each of a handful of thresholds (percentile, threshold), which become literals.

    df: one row per window with truth (null for idle), command, score, artifact and session. Windows are shuffled and
    sorted by session once; the runs of all thresholds are counted side by side, so no row is copied.
    """
    limits = [(r["percentile"], r["threshold"]) for r in thresholds.select("percentile", "threshold").collect()]
    each = list(enumerate(limits or [(0.0, 0.0)]))
    w = Window.partitionBy("session").orderBy(order)
    held = {f"_h{k}": F.when(~F.col("artifact") & (F.col("score") >= t), F.col("command")) for k, (_, t) in each}
    rows = df.withColumns({**held, "_at": F.row_number().over(w)})
    rows = rows.withColumns({f"_s{k}": run_start(F.col(f"_h{k}"), F.col("_at"), w) for k, _ in each})
    rows = rows.withColumns({f"_f{k}": is_fired(F.col(f"_h{k}"), F.col("_at"), F.col(f"_s{k}"), w, run) for k, _ in each})
    target = F.col("truth").isNotNull()
    agrees = target & (F.col("command") == F.col("truth"))
    counts = lambda f: {"fired": f, "tp": f & agrees, "wrong": f & target & (F.col("command") != F.col("truth")), "fp_idle": f & ~target}
    common = {"targets": target, "idle": ~target & ~F.col("artifact")}
    sums = rows.agg(*[F.count_if(c).alias(f"{n}{k}") for k, _ in each for n, c in counts(F.col(f"_f{k}")).items()], *[F.count_if(c).alias(n) for n, c in common.items()])
    cells = [F.struct(F.lit(p).alias("percentile"), F.lit(t).alias("threshold"), *[F.col(f"{n}{k}").alias(n) for n in counts(F.lit(True))], *common) for k, (p, t) in each]
    out = sums.select(F.explode(F.array(*cells)).alias("z")).where(F.lit(bool(limits))).select("z.*")
    minutes = lambda c: F.col(c) * hop_seconds / 60
    issued = F.col("tp") + F.col("wrong") + F.col("fp_idle")
    accuracy = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("wrong"))
    per_minute = (F.col("tp") + F.col("wrong")) / F.greatest(F.lit(1e-9), minutes("targets"))
    return out.withColumns(
        {
            "precision": F.when(issued > 0, F.col("tp") / issued).otherwise(0.0),
            "recall": F.col("tp") / F.greatest(F.lit(1), F.col("targets")),
            "fp_per_min": F.when(F.col("idle") > 0, F.col("fp_idle") / minutes("idle")),
            "accuracy": accuracy,
            "sel_per_min": per_minute,
            "itr": itr_bits(accuracy, per_minute),
        }
    )


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row per (truth, predicted)."""
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(cells: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Recall, precision and F1 of each class from confusion()'s cells."""
    hit = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0))
    rows = cells.groupBy(F.col(truth).alias("class")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    cols = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("predicted"))
    out = rows.join(cols, "class", "left").fillna(0, ["predicted"])
    recall = F.col("hits") / F.col("support")
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return out.withColumns({"recall": recall, "precision": precision, "f1": f1})


def cv_summary(folds: DataFrame, keys: list[str], pipeline: str, score: str) -> DataFrame:
    """Mean, spread and number of folds of each pipeline, and whether it wins its key (ties: the first by name)."""
    out = folds.groupBy(*keys, pipeline).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.count(score).alias("folds"))
    w = Window.partitionBy(*keys).orderBy(F.col("mean").desc(), F.col(pipeline))
    return out.withColumn("winner", F.row_number().over(w) == 1)


def reliability(df: DataFrame, keys: list[str], label: str, block: str, session: str, trials: int = 8, blocks: int = 3, sessions: int = 3) -> DataFrame:
    """Whether a key's cross-validation means anything: classes, and the least trials and blocks of a class, and sessions.

    NOT_ENOUGH below two classes or `trials` a class, NOT_TRUSTWORTHY below `blocks` of each class (folds would rest on
    one or two recordings), PROVISIONAL below `sessions`, else RELIABLE.
    """
    c = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_t"), F.count_distinct(block).alias("_b"))
    least = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("classes"), F.min("_t").alias("least_trials"), F.min("_b").alias("least_blocks"))
    out = least.join(df.groupBy(*keys).agg(F.count_distinct(session).alias("sessions")), keys)
    verdict = F.when((F.col("classes") < 2) | (F.col("least_trials") < trials), "NOT_ENOUGH").when(F.col("least_blocks") < blocks, "NOT_TRUSTWORTHY").when(F.col("sessions") < sessions, "PROVISIONAL").otherwise("RELIABLE")
    return out.withColumn("verdict", verdict)


def t_test(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """Welch's t, from sums."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    s = df.agg(F.avg(of(a)).alias("ma"), F.avg(of(b)).alias("mb"), F.var_samp(of(a)).alias("va"), F.var_samp(of(b)).alias("vb"), F.count(of(a)).alias("na"), F.count(of(b)).alias("nb"))
    return s.withColumn("t", (F.col("ma") - F.col("mb")) / F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb")))


def anova(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """F, eta squared and degrees of freedom of one-way layouts, from sums per group."""
    per = df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    w = Window.partitionBy(*keys)
    grand = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    out = per.withColumn("_g", grand).groupBy(*keys).agg(F.sum(F.col("n") * (F.col("m") - F.col("_g")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), (F.count(F.lit(1)) - 1).alias("df1"), (F.sum("n") - F.count(F.lit(1))).alias("df2"))
    return out.withColumns({"f": (F.col("between") / F.col("df1")) / (F.col("within") / F.col("df2")), "eta2": F.col("between") / (F.col("between") + F.col("within"))})


def beta_upper(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution, by the continued fraction of the incomplete beta function."""
    if f <= 0:
        return 1.0
    x, a, b = df2 / (df2 + df1 * f), df2 / 2, df1 / 2
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / (c or 1e-300)
        value *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    tail = front * (value - 1)
    return 1 - tail if swap else tail


def binomial_upper(hits: Column, n: Column, p: float = 0.5) -> Column:
    """Chance of `hits` or more of n, each of chance p (one row a test)."""

    @F.pandas_udf("double")
    def upper(k: pd.Series, of: pd.Series) -> pd.Series:
        tail = [1.0 if a <= 0 else beta_upper(a * (1 - p) / (p * (b - a + 1)), 2.0 * (b - a + 1), 2.0 * a) for a, b in zip(k, of)]
        return pd.Series(tail, dtype="float64")

    return upper(hits, n)


def bootstrap_interval(folds: DataFrame, keys: list[str], score: str, resamples: int = 2000, seed: int = 3, share: float = 0.95) -> DataFrame:
    """Percentile interval of the mean of a few fold scores per key; draws come from a hash, so reruns agree."""
    packed = folds.groupBy(*keys).agg(F.sort_array(F.collect_list(score)).alias("s"))
    draws = packed.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    pick = F.transform(F.sequence(F.lit(1), F.size("s")), lambda j: F.element_at("s", (F.pmod(F.xxhash64(F.lit(seed), "r", j), F.size("s").cast("bigint")) + 1).cast("int")))
    means = draws.select(*keys, (F.aggregate(pick, F.lit(0.0), lambda a, x: a + x) / F.size("s")).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", F.lit((1 - share) / 2)).alias("low"), F.percentile("m", F.lit((1 + share) / 2)).alias("high"))


def goertzel(df: DataFrame, keys: list[str], index: str, value: str, frequency: Column | float, rate: float) -> DataFrame:
    """Amplitude, phase and R2 of a sine at one frequency, least squares over all samples of each key (sums only)."""
    f = frequency if isinstance(frequency, Column) else F.lit(float(frequency))
    angle = 2 * math.pi * f * F.col(index) / rate
    s, c, x = F.sin(angle), F.cos(angle), F.col(value)
    raw = df.groupBy(*keys).agg(*[F.sum(e).alias(n) for n, e in {"ss": s * s, "cc": c * c, "sc": s * c, "_sx": s * x, "_cx": c * x, "_xx": x * x, "_s": s, "_c": c, "_x": x}.items()], F.count(value).alias("_n"))
    less = lambda both, one: F.col(both) - F.col(one) * F.col("_x") / F.col("_n")  # noqa: E731  of x without its mean
    sums = raw.withColumns({"sx": less("_sx", "_s"), "cx": less("_cx", "_c"), "xx": less("_xx", "_x")})
    det = F.col("ss") * F.col("cc") - F.col("sc") ** 2
    a, b = (F.col("sx") * F.col("cc") - F.col("cx") * F.col("sc")) / det, (F.col("cx") * F.col("ss") - F.col("sx") * F.col("sc")) / det
    return sums.select(*keys, F.sqrt(a * a + b * b).alias("amplitude"), F.atan2(b, a).alias("phase"), ((a * F.col("sx") + b * F.col("cx")) / F.col("xx")).alias("r2"))
