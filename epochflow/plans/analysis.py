"""Scores, thresholds, tests, spectra, decisions and model reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochflow.functions import columns as C
from epochflow.functions import kernels as K
from epochflow.operators import decide, learning, quality, signals, spatial, stats
from epochflow.plans.base import DECISIONS, EPOCHS, SIGNAL, decisions, epochs, long_epochs, query, rounded, signal, stream_windows, table
from epochflow.sources.scratch import staged

_SCORED = f"WITH {DECISIONS}, sc AS (SELECT *, predicted IN ('signup', 'purchase') AS active FROM decisions)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).withColumn("active", F.col("predicted").isin("signup", "purchase"))


@query(f"{_SCORED} SELECT session % 10 AS subject, round(quantile_cont(score, 0.95), 6) AS threshold FROM sc WHERE NOT active AND NOT is_artifact GROUP BY 1")
def d9_idle_threshold(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).withColumns({"subject": F.col("session") % 10, "idle": ~F.col("active")})
    return rounded(stats.idle_threshold(s, ["subject"], "score", "idle", "is_artifact"), "threshold")


@query(f"{_SCORED}, a AS (SELECT session % 10 AS subject, avg(score) FILTER (active) AS m1, avg(score) FILTER (NOT active) AS m0, stddev_pop(score) FILTER (active) AS s1, stddev_pop(score) FILTER (NOT active) AS s0, quantile_cont(score, 0.05) FILTER (active) AS p1, quantile_cont(score, 0.95) FILTER (NOT active) AS p0 FROM sc GROUP BY 1) SELECT subject, round(m1, 6) AS mean_on, round(m0, 6) AS mean_off, round(s1, 6) AS sd_on, round(s0, 6) AS sd_off, round(p1, 6) AS p05_on, round(p0, 6) AS p95_off, round((m1 - m0) / sqrt((s1 * s1 + s0 * s0) / 2), 6) AS d FROM a")
def d10_separation(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.separation(_scored(spark, sf).withColumn("subject", F.col("session") % 10), ["subject"], "score", "active")
    return rounded(out.select("subject", "mean_on", "mean_off", "sd_on", "sd_off", "p05_on", "p95_off", "d"), "mean_on", "mean_off", "sd_on", "sd_off", "p05_on", "p95_off", "d")


_SWEEP = f"WITH {DECISIONS}, t AS (SELECT p, (SELECT quantile_cont(score, [0.8, 0.9, 0.95, 0.975, 0.99]) FROM decisions WHERE predicted NOT IN ('signup', 'purchase') AND NOT is_artifact)[k] AS threshold FROM (VALUES (CAST(80 AS DOUBLE), 1), (90, 2), (95, 3), (97.5, 4), (99, 5)) v(p, k)), r AS (SELECT t.p AS percentile, threshold, d.*, CASE WHEN NOT is_artifact AND score >= threshold THEN predicted END AS held, CASE WHEN predicted IN ('signup', 'purchase') THEN 'signup' END AS truth FROM decisions d, t), i AS (SELECT *, n - row_number() OVER (PARTITION BY percentile, session, held ORDER BY n) AS g FROM r), f AS (SELECT *, held IS NOT NULL AND row_number() OVER (PARTITION BY percentile, session, held, g ORDER BY n) % 2 = 0 AS fired FROM i), a AS (SELECT percentile, threshold, count_if(fired) AS fired, count_if(fired AND truth IS NOT NULL AND predicted = truth) AS tp, count_if(fired AND truth IS NOT NULL AND predicted <> truth) AS wrong, count_if(fired AND truth IS NULL) AS fp_idle, count_if(truth IS NOT NULL) AS targets FROM f GROUP BY 1, 2), b AS (SELECT *, tp / greatest(1, tp + wrong) AS acc, (tp + wrong) / greatest(1e-9, targets / 60.0) AS spm FROM a), c AS (SELECT *, least(1 - 1e-6, greatest(1e-6, acc)) AS p FROM b)"


@query(f"{_SWEEP} SELECT percentile, round(threshold, 6) AS threshold, fired, tp, wrong, fp_idle, round(CASE WHEN tp + wrong + fp_idle > 0 THEN tp / (tp + wrong + fp_idle) ELSE 0 END, 6) AS precision, round(tp / greatest(1, targets), 6) AS recall, round(greatest(0, (1 + p * log2(p) + (1 - p) * log2(1 - p)) * spm), 5) AS itr FROM c", longs="fired tp wrong fp_idle")
def d11_d12_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf)
    target = F.col("predicted").isin("signup", "purchase")
    shares = [0.8, 0.9, 0.95, 0.975, 0.99]
    t = stats.exact_quantile(d.where(~target & ~F.col("is_artifact")), [], "score", shares, "t")
    t = t.select(F.explode(F.arrays_zip(F.array(*[F.lit(100 * s) for s in shares]).alias("percentile"), F.col("t").alias("threshold"))).alias("z")).select(F.round("z.percentile", 1).alias("percentile"), "z.threshold")
    rows = d.select("session", "n", "score", F.col("predicted").alias("command"), F.col("is_artifact").alias("artifact"), F.when(target, F.lit("signup")).alias("truth"))
    out = stats.threshold_sweep(rows, t, "n", 1.0, 2).select("percentile", "threshold", "fired", "tp", "wrong", "fp_idle", "precision", "recall", "itr")
    return rounded(rounded(out, "threshold", "precision", "recall"), "itr", digits=5)


@query(f"WITH {EPOCHS}, p AS (SELECT epoch_id, label, ch, ln(var_pop(x) + 1e-12) AS p FROM epochs WHERE label IN (0, 1) GROUP BY 1, 2, 3), a AS (SELECT ch, avg(p) FILTER (label = 1) AS m1, avg(p) FILTER (label = 0) AS m0, var_pop(p) FILTER (label = 1) AS v1, var_pop(p) FILTER (label = 0) AS v0 FROM p GROUP BY 1) SELECT ch, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS d, CASE WHEN abs((m1 - m0) / sqrt((v1 + v0) / 2)) >= 1.5 THEN 'GO' WHEN abs((m1 - m0) / sqrt((v1 + v0) / 2)) >= 0.8 THEN 'MARGINAL' ELSE 'NO_GO' END AS tier FROM a")
def d4_d13_channel_effect(spark: SparkSession, sf: str) -> DataFrame:
    p = long_epochs(spark, sf).where("label in (0, 1)").groupBy("epoch_id", "label", "ch").agg(C.log_variance(F.var_pop("x")).alias("p"))
    of = lambda f, y: f(F.when(F.col("label") == y, F.col("p")))
    d = p.groupBy("ch").agg(stats.cohen_d(of(F.avg, 1), of(F.var_pop, 1), of(F.avg, 0), of(F.var_pop, 0)).alias("d"))
    return d.select("ch", F.round("d", 6).alias("d"), F.when(F.abs("d") >= 1.5, "GO").when(F.abs("d") >= 0.8, "MARGINAL").otherwise("NO_GO").alias("tier"))


@query(f"WITH {SIGNAL}, g AS (SELECT channel, user_id % 4 AS grp, x FROM signal), p AS (SELECT channel, grp, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM g GROUP BY 1, 2), t AS (SELECT channel, sum(n * m) / sum(n) AS gm FROM p GROUP BY 1), s AS (SELECT channel, sum(n * (m - gm) ** 2) AS b, sum(n * v) AS w, count(*) - 1 AS df1, sum(n) - count(*) AS df2 FROM p JOIN t USING (channel) GROUP BY 1) SELECT channel, round((b / df1) / (w / df2), 6) AS f, round(b / (b + w), 6) AS eta2 FROM s")
def d15_f5_anova(spark: SparkSession, sf: str) -> DataFrame:
    g = signal(spark, sf).withColumn("grp", F.col("user_id") % 4)
    return rounded(stats.anova(g, ["channel"], "x", "grp").select("channel", "f", "eta2"), "f", "eta2")


@query("SELECT round((avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view')) / sqrt(var_samp(value) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'click') + var_samp(value) FILTER (event_type = 'view') / count(*) FILTER (event_type = 'view')), 6) AS t, count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'view') AS nb FROM events")
def d15_t_test(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.t_test(table(spark, sf, "events"), "value", "event_type", "click", "view").select("t", "na", "nb"), "t")


@query("SELECT label, count(*) AS n, round(count(*) / max(count(*)) OVER (), 6) AS balance FROM embeddings GROUP BY 1")
def d16_class_balance(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", "n", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6).alias("balance"))  # one row a class


@query(f"WITH {SIGNAL} SELECT channel, round(stddev_pop(x), 6) AS rms, count(DISTINCT round(x, 3)) AS distinct_values, CASE WHEN stddev_pop(x) < 1 THEN 'dead' WHEN count(DISTINCT round(x, 3)) < 10 THEN 'stuck' WHEN stddev_pop(x) > 200 THEN 'saturated' WHEN stddev_pop(x) > 100 THEN 'noisy' ELSE 'ok' END AS tier FROM signal GROUP BY 1")
def d17_hardware_tiers(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf).groupBy("channel").agg(F.stddev_pop("x").alias("rms"), F.count_distinct(F.round("x", 3)).alias("distinct_values"))
    return s.select("channel", F.round("rms", 6).alias("rms"), "distinct_values", quality.hardware_tier(F.col("rms"), F.col("distinct_values")).alias("tier"))


@query("WITH c AS (SELECT user_id, event_type, stddev_pop(value) AS sd, count(DISTINCT round(value, 3)) AS dv, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, CASE WHEN sd < 1 THEN 'dead' WHEN dv < 10 THEN 'stuck' WHEN sd > 200 THEN 'saturated' WHEN sd > 100 THEN 'noisy' ELSE 'ok' END AS tier FROM c) SELECT user_id, count(*) AS channels, count_if(tier IN ('dead', 'stuck', 'saturated')) AS bad, round(max(abs(n / 13.0 - 1)), 6) AS rate_error, CASE WHEN count_if(tier IN ('dead', 'stuck', 'saturated')) = 0 AND max(abs(n / 13.0 - 1)) <= 0.15 THEN 'READY' ELSE 'BLOCKED' END AS verdict FROM t GROUP BY 1", longs="bad")
def d18_k18_preflight(spark: SparkSession, sf: str) -> DataFrame:
    st = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.stddev_pop("value").alias("std"), F.count_distinct(F.round("value", 3)).alias("distinct_values"), F.count(F.lit(1)).alias("n"))
    return rounded(quality.preflight(st, ["user_id"], F.col("n"), 13.0), "rate_error")


@query(f"WITH {DECISIONS} SELECT session, round(count(*) / ((max(t_ms) - min(t_ms)) / 1000.0), 9) AS rate, count(*) AS n, round(100 * (count(*) / ((max(t_ms) - min(t_ms)) / 1000.0) / 0.00001 - 1), 5) AS error_pct, round((count(*) - 2) / ((max(t_ms) - min(t_ms)) / 1000.0), 9) AS windows_per_s, round(count_if(is_artifact) / count(*), 6) AS drop_rate FROM decisions GROUP BY 1 HAVING count(*) > 1")
def d21_i12_stream_rate(spark: SparkSession, sf: str) -> DataFrame:
    r = decisions(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("n"), (F.max("t_ms") - F.min("t_ms")).alias("span"), F.count_if("is_artifact").alias("dropped")).where("n > 1")
    seconds = F.col("span") / 1000.0
    rate, after = F.col("n") / seconds, (F.col("n") - 2) / seconds  # two windows prime a stream
    return r.select("session", F.round(rate, 9).alias("rate"), "n", F.round(100 * (rate / 0.00001 - 1), 5).alias("error_pct"), F.round(after, 9).alias("windows_per_s"), F.round(F.col("dropped") / F.col("n"), 6).alias("drop_rate"))


@query("SELECT l_suppkey, CASE WHEN count(*) FILTER (l_returnflag <> 'N') = 0 THEN NULL ELSE round(count(*) FILTER (l_returnflag = 'R') / count(*) FILTER (l_returnflag <> 'N'), 6) END AS accuracy, count(*) FILTER (l_returnflag <> 'N') AS feedback FROM lineitem GROUP BY 1")
def d23_manual_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("hit"), F.count_if(F.col("l_returnflag") != "N").alias("feedback"))
    return l.select("l_suppkey", F.round(F.when(F.col("feedback") > 0, F.col("hit") / F.col("feedback")), 6).alias("accuracy"), "feedback")


_COV = f"WITH {EPOCHS}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY epoch_id, ch) AS v FROM epochs), q AS (SELECT a.epoch_id, a.label, a.ch AS i, b.ch AS j, sum(a.v * b.v) AS s FROM c a JOIN c b USING (epoch_id, s) GROUP BY 1, 2, 3, 4), tr AS (SELECT epoch_id, sum(s) AS t FROM q WHERE i = j GROUP BY 1), cov AS (SELECT epoch_id, label, i, j, 0.95 * s / t + CASE WHEN i = j THEN 0.05 / 8 ELSE 0 END AS c FROM q JOIN tr USING (epoch_id))"


@query(f"{_COV} SELECT epoch_id, i, j, round(c, 6) AS c FROM cov")
def d24_trial_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.long_covariance(epochs(spark, sf), "epoch_id", "label").select("epoch_id", "i", "j", F.round("c", 6).alias("c"))


@query(f"{_COV} SELECT label, i, j, round(avg(c), 6) AS c FROM cov GROUP BY 1, 2, 3")
def d25_class_mean_covariance(spark: SparkSession, sf: str) -> DataFrame:
    c = epochs(spark, sf).select("label", signals.covariance(F.col("signal")).alias("cov")).select("label", F.posexplode("cov").alias("p", "c"))
    return c.groupBy("label", F.floor(F.col("p") / 8).alias("i"), (F.col("p") % 8).alias("j")).agg(F.round(F.avg("c"), 6).alias("c"))


_CONF = "cf AS (SELECT l_returnflag AS truth, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 40 THEN 'N' ELSE 'R' END AS predicted, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("truth"), F.when(q < 15, "A").when(q < 40, "N").otherwise("R").alias("predicted"))
    return stats.confusion(rows, "truth", "predicted")


@query(f"WITH {_CONF}, r AS (SELECT truth AS class, sum(n) AS support, sum(CASE WHEN truth = predicted THEN n ELSE 0 END) AS hits FROM cf GROUP BY 1), p AS (SELECT predicted AS class, sum(n) AS predicted FROM cf GROUP BY 1) SELECT class, support, round(hits / support, 6) AS recall, round(hits / predicted, 6) AS precision, round(2 * hits / (support + predicted), 6) AS f1 FROM r JOIN p USING (class)", longs="support")
def d33_class_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.class_report(_confusion(spark, sf), "truth", "predicted").select("class", "support", "recall", "precision", "f1"), "recall", "precision", "f1")


@query(f"WITH {_CONF}, r AS (SELECT truth, sum(CASE WHEN truth = predicted THEN n ELSE 0 END) / sum(n) AS recall FROM cf GROUP BY 1) SELECT round(avg(recall), 6) AS balanced_accuracy, (SELECT round(sum(CASE WHEN truth = predicted THEN n ELSE 0 END) / sum(n), 6) FROM cf) AS accuracy FROM r")
def d33_balanced_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    report = stats.class_report(_confusion(spark, sf), "truth", "predicted")
    return report.agg(F.round(F.avg("recall"), 6).alias("balanced_accuracy"), F.round(F.sum("hits") / F.sum("support"), 6).alias("accuracy"))


@query("WITH f AS (SELECT o_custkey % 20 AS person, o_orderpriority AS pipeline, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2, o_orderkey % 5), s AS (SELECT person, pipeline, avg(score) AS mean, stddev_pop(score) AS sd, count(*) AS folds FROM f GROUP BY 1, 2) SELECT person, pipeline, round(mean, 6) AS mean, round(sd, 4) AS sd, folds, row_number() OVER (PARTITION BY person ORDER BY mean DESC, pipeline) = 1 AS winner FROM s")
def d34_cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 20).alias("person"), F.col("o_orderpriority").alias("pipeline"), F.col("o_orderkey") % 5).agg(F.avg("o_totalprice").alias("score"))
    return rounded(rounded(stats.cv_summary(f, ["person"], "pipeline", "score"), "mean"), "sd", digits=4)


@query("WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice / 100000 AS acc, lag(o_totalprice / 100000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) SELECT o_custkey, o_orderkey, CASE WHEN prev IS NULL THEN 'first' WHEN acc - prev > 0.005 THEN 'improved' WHEN acc - prev < -0.005 THEN 'declined' ELSE 'unchanged' END AS change FROM v")
def d39_training_delta(spark: SparkSession, sf: str) -> DataFrame:
    acc = F.col("o_totalprice") / 100000
    gain = acc - F.lag(acc).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    change = F.when(gain.isNull(), "first").when(gain > 0.005, "improved").when(gain < -0.005, "declined").otherwise("unchanged")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", change.alias("change"))


@query(f"WITH {DECISIONS}, s AS (SELECT session, n, CASE WHEN score > 150 THEN 'FAIL' ELSE 'PASS' END AS status FROM decisions), g AS (SELECT *, coalesce(bool_or(status = 'FAIL') OVER (PARTITION BY session ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before, min(CASE WHEN status = 'FAIL' THEN n END) OVER (PARTITION BY session) AS first_fail FROM s) SELECT session, n, CASE WHEN before THEN 'SKIP' ELSE status END AS gated, first_fail FROM g")
def d41_layered_gate(spark: SparkSession, sf: str) -> DataFrame:
    s = decisions(spark, sf).select("session", "n", F.when(F.col("score") > 150, "FAIL").otherwise("PASS").alias("status"))
    return quality.gates(s, ["session"], "n", "status").select("session", "n", "gated", "first_fail")


@query(f"WITH {DECISIONS}, g AS (SELECT session, t_ms - lag(t_ms) OVER (PARTITION BY session ORDER BY n) AS gap FROM decisions) SELECT session, round(avg(gap), 3) AS mean, round(stddev_pop(gap), 3) AS sd, max(gap) AS longest, round(quantile_cont(gap, 0.99), 3) AS p99, round(100 * stddev_pop(gap) / avg(gap), 4) AS jitter_pct, count_if(gap > 1.5 * 40000000) AS dropped FROM g WHERE gap IS NOT NULL GROUP BY 1", longs="dropped")
def d44_timing(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.col("t_ms") - F.lag("t_ms").over(Window.partitionBy("session").orderBy("n"))
    g = decisions(spark, sf).select("session", gap.alias("gap")).where("gap is not null")
    out = g.groupBy("session").agg(F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.max("gap").alias("longest"), F.round(100 * F.stddev_pop("gap") / F.avg("gap"), 4).alias("jitter_pct"), F.count_if(F.col("gap") > 1.5 * 40_000_000).alias("dropped"))
    late = stats.exact_quantile(g, ["session"], "gap", [0.99]).select("session", F.col("quantiles")[0].alias("p99"))
    return rounded(out.join(late, "session"), "mean", "sd", "p99", digits=3)


@query("SELECT p_partkey, p_size AS n, CAST(ceil(log2(p_size)) AS INT) AS deepest, round(0.614 ** ceil(log2(p_size)), 6) AS success FROM part WHERE p_size >= 2")
def d45_selection_cost(spark: SparkSession, sf: str) -> DataFrame:
    deepest = F.ceil(F.log2("p_size"))
    return table(spark, sf, "part").where("p_size >= 2").select("p_partkey", F.col("p_size").alias("n"), deepest.cast("int").alias("deepest"), F.round(F.pow(F.lit(0.614), deepest), 6).alias("success"))


@query(f"WITH {DECISIONS}, cue AS (SELECT session, n, t_ms FROM decisions WHERE predicted = 'signup'), sel AS (SELECT session, t_ms, predicted FROM decisions WHERE predicted IN ('purchase', 'click')), first AS (SELECT c.session, c.n, min(s.t_ms) AS at_ms, min_by(s.predicted, s.t_ms) AS chosen, any_value(c.t_ms) AS cue_ms FROM cue c LEFT JOIN sel s ON s.session = c.session AND s.t_ms > c.t_ms GROUP BY 1, 2) SELECT session, count(*) AS cues, round(count_if(chosen = 'purchase') / count(*), 6) AS first_accuracy, round(quantile_cont(at_ms - cue_ms, 0.5), 3) AS p50, round(quantile_cont(at_ms - cue_ms, 0.9), 3) AS p90 FROM first GROUP BY 1")
def d46_online_metrics(spark: SparkSession, sf: str) -> DataFrame:
    # Backwards, as a frame that only grows is carried from row to row.
    w = Window.partitionBy("session").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(F.col("predicted").isin("purchase", "click"), F.struct("t_ms", "predicted")), ignorenulls=True).over(w)
    cues = decisions(spark, sf).withColumn("hit", after).where("predicted = 'signup'")  # one that no selection follows is missed
    cues = cues.withColumn("wait", F.col("hit.t_ms") - F.col("t_ms"))
    out = cues.groupBy("session").agg(F.count(F.lit(1)).alias("cues"), (F.count_if(F.col("hit.predicted") == "purchase") / F.count(F.lit(1))).alias("first_accuracy"))
    waits = stats.exact_quantile(cues, ["session"], "wait", [0.5, 0.9]).select("session", F.col("quantiles")[0].alias("p50"), F.col("quantiles")[1].alias("p90"))
    out = out.join(waits, "session", "left")
    return rounded(rounded(out, "first_accuracy"), "p50", "p90", digits=3)


# Spectra

@query(f"WITH {EPOCHS}, b AS (SELECT epoch_id, ch, k AS bin, sum(x * cos(2 * pi() * ((k * s) % 8) / 8)) AS re, sum(x * sin(2 * pi() * ((k * s) % 8) / 8)) AS im FROM epochs, range(5) t(k) GROUP BY 1, 2, 3) SELECT epoch_id, ch, CAST(bin AS INT) AS bin, round(CASE WHEN bin IN (0, 4) THEN 1 ELSE 2 END / 8.0 * sqrt(re * re + im * im), 6) AS amplitude FROM b")
def h7_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    out = signals.spectrum(long_epochs(spark, sf), ["epoch_id", "ch"], "s", "x", 8, 250.0)
    return rounded(out.select("epoch_id", "ch", "bin", "amplitude"), "amplitude")


@query(f"WITH {SIGNAL}, a AS (SELECT channel, sin(2 * pi() * 10 * i / 250) AS s, cos(2 * pi() * 10 * i / 250) AS c, x - avg(x) OVER (PARTITION BY channel) AS x FROM signal), u AS (SELECT channel, sum(s*s) ss, sum(c*c) cc, sum(s*c) sc, sum(s*x) sx, sum(c*x) cx, sum(x*x) xx FROM a GROUP BY 1), v AS (SELECT *, (sx*cc - cx*sc) / (ss*cc - sc*sc) AS a, (cx*ss - sx*sc) / (ss*cc - sc*sc) AS b FROM u) SELECT channel, round(sqrt(a*a + b*b), 6) AS amplitude, round(atan2(b, a), 5) AS phase, round((a*sx + b*cx) / xx, 6) AS r2 FROM v")
def h5_h13_sine_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(stats.goertzel(signal(spark, sf), ["channel"], "i", "x", 10.0, 250.0), "amplitude", "r2"), "phase", digits=5)


@query(f"WITH {EPOCHS} SELECT a.epoch_id, round(corr(a.x, b.x), 6) AS r FROM epochs a JOIN epochs b USING (epoch_id, s) WHERE a.ch = 6 AND b.ch = 7 GROUP BY 1")
def h6_pearson(spark: SparkSession, sf: str) -> DataFrame:
    two = epochs(spark, sf).select("epoch_id", C.pick_channels(F.col("signal"), [6, 7]).alias("p"))
    rows = two.select("epoch_id", F.explode(F.arrays_zip(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"))).alias("z"))
    return rows.groupBy("epoch_id").agg(F.round(F.corr("z.a", "z.b"), 6).alias("r"))


# Decisions

_MACHINE = f"WITH RECURSIVE {DECISIONS}, m AS (SELECT session, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS lab, 0 AS run, CAST(-1e18 AS DOUBLE) AS lock, CAST(-1e18 AS DOUBLE) AS last FROM decisions WHERE n = 1 UNION ALL SELECT session, n, state, CASE WHEN state IN ('BUILDING', 'REFRACTORY') THEN command END, CASE WHEN state IN ('BUILDING', 'REFRACTORY') THEN run2 ELSE 0 END, CASE WHEN state = 'BLINK' THEN t_ms + 60000000 ELSE lock END, CASE WHEN state = 'DISPATCHED' THEN t_ms ELSE last END FROM (SELECT *, CASE WHEN t_ms < lock THEN 'LOCKOUT' WHEN is_artifact THEN 'BLINK' WHEN command IS NULL THEN 'REJECTED' WHEN run2 < 2 THEN 'BUILDING' WHEN t_ms - last < 90000000 THEN 'REFRACTORY' ELSE 'DISPATCHED' END AS state FROM (SELECT d.session, d.n, d.t_ms, d.command, d.is_artifact, m.lock, m.last, CASE WHEN d.command = m.lab THEN m.run + 1 ELSE 1 END AS run2 FROM m JOIN decisions d ON d.session = m.session AND d.n = m.n + 1)))"


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    """Times are minutes apart in these tables, so the locks are in minutes as well."""
    return decide.decide(decisions(spark, sf), run=2, lockout=60_000_000, refractory=90_000_000)


@query(f"{_MACHINE} SELECT session, n, state FROM m WHERE n > 0")
def i5_decision_machine(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("session", "n", "state")


@query(f"{_MACHINE} SELECT session, count(*) AS windows, count_if(state = 'DISPATCHED') AS dispatched, count_if(state = 'REJECTED') AS rejected, count_if(state IN ('BLINK', 'LOCKOUT')) AS locked FROM m WHERE n > 0 GROUP BY 1", longs="dispatched rejected locked")
def d22_decision_report(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("state")
    return _decided(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("windows"), F.count_if(s == decide.DISPATCHED).alias("dispatched"), F.count_if(s == decide.REJECTED).alias("rejected"), F.count_if(s.isin(decide.BLINK, decide.LOCKOUT)).alias("locked"))


@query(f"{_MACHINE} SELECT m.session, m.n, d.command FROM m JOIN decisions d USING (session, n) WHERE m.state = 'DISPATCHED'")
def i11_command_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).where(F.col("state") == decide.DISPATCHED).select("session", "n", "command")


_LEFT = f"{DECISIONS}, l AS (SELECT session, n, predicted IN ('view', 'click') AS is_left FROM decisions)"


def _left(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).select("session", "n", F.col("predicted").isin("view", "click").alias("is_left"))


@query(f"WITH RECURSIVE {_LEFT}, m AS (SELECT session, CAST(0 AS BIGINT) AS n, 0 AS low, 5 AS size, CAST(NULL AS INT) AS chosen FROM l WHERE n = 1 UNION ALL SELECT session, n, CASE WHEN s2 = 1 THEN 0 ELSE l2 END, CASE WHEN s2 = 1 THEN 5 ELSE s2 END, CASE WHEN s2 = 1 THEN l2 END FROM (SELECT l.session, l.n, CASE WHEN is_left THEN low ELSE low + (size + 1) // 2 END AS l2, CASE WHEN is_left THEN (size + 1) // 2 ELSE size - (size + 1) // 2 END AS s2 FROM m JOIN l ON l.session = m.session AND l.n = m.n + 1)) SELECT session, n, chosen FROM m WHERE n > 0")
def i6_tree_selection(spark: SparkSession, sf: str) -> DataFrame:
    return decide.select(_left(spark, sf), decide.Tree, 5)


@query(f"WITH {_LEFT} SELECT session, n, CASE WHEN NOT is_left THEN count_if(is_left) OVER (PARTITION BY session ORDER BY n) % 5 END AS chosen FROM l", longs="chosen")
def i7_scan_selection(spark: SparkSession, sf: str) -> DataFrame:
    left = F.count_if("is_left").over(Window.partitionBy("session").orderBy("n"))
    return _left(spark, sf).select("session", "n", F.when(~F.col("is_left"), left % 5).alias("chosen"))


@query()
def i10_h3_typed_text(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations")
    token = F.when(F.col("turn") % 7 == 3, decide.UNDO).when(F.col("turn") % 5 == 2, decide.SPACE).when(F.col("turn") % 6 == 4, decide.BACKSPACE).otherwise(F.substring("text", 1, 1))
    return decide.typed(t.select(F.col("conv_id").alias("session"), F.col("turn").cast("bigint").alias("n"), token.alias("value")))


# Kernels over epochs, and models

@query()
def h8_h9_h19_bandpass(spark: SparkSession, sf: str) -> DataFrame:
    e = epochs(spark, sf).select("epoch_id", signals.bandpassed(F.col("signal"), 250.0, 8.0, 30.0).alias("y"))
    return e.select("epoch_id", F.posexplode("y").alias("ch", "y"))


@query()
def h17_blink(spark: SparkSession, sf: str) -> DataFrame:
    return epochs(spark, sf).select("epoch_id", signals.blink(F.col("signal"), 250.0, [0, 1], 0.2).alias("blink"))


_GATE = f"WITH {EPOCHS}, b AS (SELECT epoch_id, ch, k AS bin, sum(x * cos(2 * pi() * ((k * s) % 8) / 8)) AS re, sum(x * sin(2 * pi() * ((k * s) % 8) / 8)) AS im FROM epochs, range(5) t(k) GROUP BY 1, 2, 3), g AS (SELECT *, CASE WHEN bin IN (0, 4) THEN 1 ELSE 2 END / 8.0 AS share FROM b), y AS (SELECT epoch_id, ch, CAST(t.s AS INT) AS s, sum(CASE WHEN share * sqrt(re * re + im * im) >= 0.08 THEN share * (re * cos(2 * pi() * ((bin * t.s) % 8) / 8) + im * sin(2 * pi() * ((bin * t.s) % 8) / 8)) ELSE 0 END) AS y FROM g, range(8) t(s) GROUP BY 1, 2, 3)"


@query(f"{_GATE} SELECT epoch_id, ch, s, round(y, 5) AS y FROM y")
def h8_spectral_gate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.gated_spectrum(long_epochs(spark, sf), ["epoch_id", "ch"], "s", "x", 8, 0.08), "y", digits=5)


@query()
def h9_notch(spark: SparkSession, sf: str) -> DataFrame:
    """Mains hum at 50 Hz taken out of windows of the stream: what is left of each channel."""
    w = stream_windows(spark, sf).select("epoch_id", F.posexplode(signals.notched(F.col("signal"), 250.0)).alias("ch", "y"))
    return w.select("epoch_id", "ch", F.explode("y").alias("y")).groupBy("epoch_id", "ch").agg(F.stddev_pop("y").alias("std"), F.count(F.lit(1)).alias("n"))


@query()
def h11_k16_signal_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether windows carry the expected test signal: a square wave at 10 Hz on the best channel."""
    w = stream_windows(spark, sf).withColumn("shapes", signals.shapes(F.col("signal"), 250.0, 10.0))
    t = signals.tones(w, 250.0)
    shape = F.element_at("shapes", F.col("tone_channel") + 1)
    off = F.abs(F.col("frequency") - 10.0)
    verdict = F.when((off <= 0.5) & (F.col("snr") >= 30) & (shape["shape"] == "square"), "PASS").when(F.col("snr") < 30, "NO_TONE").when(off > 0.5, "OTHER_TONE").otherwise("OTHER_SHAPE")
    return t.select("epoch_id", "tone_channel", "frequency", "snr", shape["shape"].alias("shape"), shape["ratio"].alias("ratio"), verdict.alias("verdict"))


@query()
def h20_h18_fbcca(spark: SparkSession, sf: str) -> DataFrame:
    """Filter-bank scores and plain canonical correlations of windows of 750 samples, and the best class by each."""
    every = [0, 1, 2, 3, 4]
    s = signals.fbcca_scores(F.col("signal"), [15.0, 20.0], 250.0, every)
    c = signals.cca_scores(F.col("signal"), [15.0, 20.0], 250.0, every)
    e = stream_windows(spark, sf).select("epoch_id", s.alias("s"), c.alias("c"))
    best = lambda x: F.when(x[1] > x[0], 1).otherwise(0)
    return e.select("epoch_id", F.col("s")[0].alias("s0"), F.col("s")[1].alias("s1"), best(F.col("s")).alias("best"), F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"), best(F.col("c")).alias("plain_best"))


@query()
def h22_d20_band_power(spark: SparkSession, sf: str) -> DataFrame:
    e = epochs(spark, sf).select("epoch_id", signals.band_powers(F.col("signal"), 250.0, (8.0, 40.0)).alias("p"))
    return e.select("epoch_id", F.posexplode("p").alias("ch", "power"))


@query()
def h11_h12_k16_tones(spark: SparkSession, sf: str) -> DataFrame:
    return signals.tones(epochs(spark, sf).select("epoch_id", "signal"), 250.0, low=20.0, high=110.0).drop("signal")


def _covariances(spark: SparkSession, sf: str) -> DataFrame:
    return epochs(spark, sf).select("epoch_id", "label", "signal", signals.covariance(F.col("signal")).alias("cov"))


@query()
def d26_h25_a16_tangent(spark: SparkSession, sf: str) -> DataFrame:
    c = _covariances(spark, sf)
    mean = spatial.frechet_mean(c)
    return spatial.tangent_features(c.select("epoch_id", "label", "cov"), mean).select("epoch_id", "label", "features")


@query()
def d27_h23_csp(spark: SparkSession, sf: str) -> DataFrame:
    c = _covariances(spark, sf).where("label in (0, 1)")
    return spatial.csp_features(c, spatial.csp_filters(c, "label", (0, 1))).select("epoch_id", "label", "features")


@query()
def d28_h21_trca(spark: SparkSession, sf: str) -> DataFrame:
    e = epochs(spark, sf)
    return spatial.trca_scores(e, spatial.trca_filters(e, "label")).select("epoch_id", "label", "scores")


def _folds(spark: SparkSession, sf: str) -> DataFrame:
    """People of 250 trials each, more of them in larger tables; the folds are five sets of runs, so no run is on both sides."""
    e = epochs(spark, sf)
    return e.select(F.floor(F.col("epoch_id") / 250).alias("subject"), (F.floor(F.col("epoch_id") / 10) % 5).cast("int").alias("fold"), (F.col("label") % 2).alias("y"), "signal", "epoch_id")


@query()
def k5_k7_cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The four motor-imagery pipelines under the same folds of whole runs."""
    return learning.cross_validate(_folds(spark, sf), "subject", "fold", "y", learning.MOTOR)


def _stream_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of the stream as trials of two targets in sessions of 50; runs of four windows share a fold."""
    return stream_windows(spark, sf).select("epoch_id", F.floor(F.col("epoch_id") / 50).alias("subject"), (F.floor(F.col("epoch_id") / 4) % 5).cast("int").alias("fold"), (F.col("epoch_id") % 2).alias("y"), "signal")


@query()
def d28_h21_filter_bank_trca(spark: SparkSession, sf: str) -> DataFrame:
    """Filter-bank ensemble scores of windows of 750 samples; three bands are summed in one pass."""
    w = staged(_stream_trials(spark, sf), "windows")
    found = spatial.trca_filters(w, "y", bands=K.SUB_BANDS)
    return spatial.trca_scores(w, found, bands=K.SUB_BANDS).select("epoch_id", F.col("y").alias("label"), "scores")


@query()
def k4_k9_d34_model_choice(spark: SparkSession, sf: str) -> DataFrame:
    """FBCCA, which needs no training, against filter-bank TRCA on the same folds of windows of the stream.

    separation: Cohen's d of how far the best score is above the second, of right against wrong windows, over all folds.
    """
    w = staged(_stream_trials(spark, sf), "windows")
    scored = learning.held_out_scores(w, "subject", "fold", "y", ["fbcca", "trca"])
    right = F.col("predicted") == F.col("y")
    margin = stats.separation(scored.withColumn("right", right), ["pipeline"], "margin", "right").select("pipeline", F.col("d").alias("separation"))
    folds = scored.groupBy("subject", "pipeline", "fold").agg(F.avg(right.cast("double")).alias("accuracy"))
    return stats.cv_summary(folds, ["subject"], "pipeline", "accuracy").join(F.broadcast(margin), "pipeline")


@query()
def d36_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 20).alias("person"), (F.col("o_orderkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("score"))
    return stats.bootstrap_interval(f, ["person"], "score", 2000)


@query()
def k1_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """A profile per subject: threshold, separation and staleness in one job."""
    s = _scored(spark, sf).withColumns({"subject": F.col("session") % 10, "idle": ~F.col("active")})
    t = stats.idle_threshold(s, ["subject"], "score", "idle", "is_artifact")
    return t.join(stats.separation(s, ["subject"], "score", "active").select("subject", "d"), "subject")


