"""Reports over features and models: feature scores, permutation and learning curves, leakage, fold building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochflow.functions import columns as C
from epochflow.functions import kernels as K
from epochflow.operators import estimators, information, learning, quality, signals, spatial, stats, windows
from epochflow.plans.analysis import _folds
from epochflow.plans.base import DECISIONS, EPOCHS, decisions, epochs, long_epochs, query, stream_windows, table
from epochflow.plans.streams import _LIMITS
from epochflow.sources.scratch import scratch_path, staged


@query(f"WITH {EPOCHS}, p AS (SELECT epoch_id, label, ch, ln(var_pop(x) + 1e-12) AS p FROM epochs GROUP BY 1, 2, 3), m AS (SELECT label, ch, quantile_cont(p, 0.5) AS m FROM p GROUP BY 1, 2), d AS (SELECT p.*, m, abs(p - m) AS d FROM p JOIN m USING (label, ch)), mad AS (SELECT label, ch, quantile_cont(d, 0.5) AS mad FROM d GROUP BY 1, 2) SELECT epoch_id, ch, round(CASE WHEN mad > 0 THEN 0.6745 * (p - m) / mad ELSE 0 END, 5) AS z FROM d JOIN mad USING (label, ch)")
def d5_robust_z(spark: SparkSession, sf: str) -> DataFrame:
    p = long_epochs(spark, sf).groupBy("epoch_id", "label", "ch").agg(C.log_variance(F.var_pop("x")).alias("p"))
    return quality.robust_z(p, ["label", "ch"], "p").select("epoch_id", "ch", F.round("z", 5).alias("z"))


@query(f"WITH {EPOCHS}, p AS (SELECT epoch_id, label % 2 AS y, ch, ln(var_pop(x) + 1e-12) AS p FROM epochs GROUP BY 1, 2, 3), c AS (SELECT ch, y, count(*) AS n, avg(p) AS m, var_pop(p) AS v FROM p GROUP BY 1, 2), g AS (SELECT ch, sum(n * m) / sum(n) AS g FROM c GROUP BY 1), f AS (SELECT ch, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM c JOIN g USING (ch) GROUP BY 1) SELECT ch AS feature, round(f, 5) AS f FROM f ORDER BY f DESC LIMIT 3")
def d32_best_features(spark: SparkSession, sf: str) -> DataFrame:
    p = long_epochs(spark, sf).withColumn("y", F.col("label") % 2).groupBy("epoch_id", "y", F.col("ch").alias("feature")).agg(C.log_variance(F.var_pop("x")).alias("v"))
    return stats.anova(p, ["feature"], "v", "y").orderBy(F.col("f").desc()).limit(3).select("feature", F.round("f", 5).alias("f"))


_PSI = "(coalesce(list_sum(list_transform(range(1, CAST({} AS BIGINT)), lambda i: 1.0 / i)), 0) - 0.57721566490153286)"


@query(
    f"WITH {EPOCHS}, p AS (SELECT epoch_id, label, ch, ln(var_pop(x) + 1e-12) AS v FROM epochs GROUP BY 1, 2, 3), own AS (SELECT label, count(DISTINCT epoch_id) AS own FROM p GROUP BY 1 HAVING own > 1), q AS (SELECT p.*, own FROM p JOIN own USING (label)), "
    "near AS (SELECT a.ch, a.epoch_id, any_value(a.v) AS v, any_value(a.own) AS own, list_sort(list(abs(b.v - a.v)))[least(3, any_value(a.own) - 1)] AS d FROM q a JOIN q b ON a.ch = b.ch AND a.label = b.label AND a.epoch_id <> b.epoch_id GROUP BY 1, 2), "
    "c AS (SELECT n.ch, n.epoch_id, any_value(n.own) AS own, greatest(1, count_if(CASE WHEN n.d > 0 THEN abs(q.v - n.v) < n.d ELSE q.v = n.v END)) AS m FROM near n JOIN q ON q.ch = n.ch GROUP BY 1, 2) "
    f"SELECT ch AS feature, count(*) AS n, round(greatest(0, {_PSI.format('count(*)')} + avg({_PSI.format('least(3, own - 1)')}) - avg({_PSI.format('own')}) - avg({_PSI.format('m')})), 6) AS mi FROM c GROUP BY 1"
)
def d32_mutual_information(spark: SparkSession, sf: str) -> DataFrame:
    """What each channel's log power tells of the class, by nearest neighbours; no channel is ordered in one task."""
    p = long_epochs(spark, sf).groupBy("epoch_id", "label", "ch").agg(C.log_variance(F.var_pop("x")).alias("v"))
    return information.mutual_information(p, "ch", "v", "label").select(F.col("ch").alias("feature"), "n", F.round("mi", 6).alias("mi"))


@query("WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) SELECT doc_id, count(*) AS words, max(length(w)) AS longest FROM w GROUP BY 1")
def h4_wrapped_words(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.max(F.length("w")).cast("bigint").alias("longest"))


@query("WITH g AS (SELECT vec_id % 10 AS subject, count(*) AS n FROM embeddings GROUP BY 1) SELECT subject, n, sum(n) OVER (ORDER BY n DESC, subject ROWS UNBOUNDED PRECEDING) AS running FROM g", longs="running")
def k3_largest_first(spark: SparkSession, sf: str) -> DataFrame:
    g = epochs(spark, sf).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return g.select("subject", "n", F.sum("n").over(Window.orderBy(F.col("n").desc(), "subject").rowsBetween(Window.unboundedPreceding, 0)).alias("running"))  # one row a group


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS report FROM events")
def a23_json_reports(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", F.col("event_type").alias("kind"))).alias("report"))


@query()
def d14_mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each pair of class means under the pooled covariance of log powers; moments are sums per class."""
    import numpy as np

    p = long_epochs(spark, sf).groupBy("epoch_id", "label", "ch").agg(C.log_variance(F.var_pop("x")).alias("p"))
    wide = p.groupBy("epoch_id", "label").pivot("ch", list(range(8))).agg(F.first("p"))
    moments = [F.covar_samp(F.col(str(i)), F.col(str(j))).alias(f"c{i}_{j}") for i in range(8) for j in range(i, 8)]
    rows = wide.groupBy("label").agg(*[F.avg(str(i)).alias(f"m{i}") for i in range(8)], *moments).orderBy("label").collect()  # one row a class
    means = np.array([[r[f"m{i}"] for i in range(8)] for r in rows])
    pooled = np.mean([[[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(8)] for i in range(8)] for r in rows], axis=0)
    inverse = np.linalg.pinv(pooled)
    out = [(int(a["label"]), int(b["label"]), float(np.sqrt(max(0.0, (x - y) @ inverse @ (x - y))))) for a, x in zip(rows, means) for b, y in zip(rows, means) if a["label"] < b["label"]]
    return spark.createDataFrame(out, "a int, b int, distance double")


@query()
def d35_permutation_test(spark: SparkSession, sf: str) -> DataFrame:
    """Share of 200 label shuffles (within person) that score as well as the true labels, each learned anew."""
    by = staged(learning.permutation_scores(_folds(spark, sf), "subject", "fold", "y", "epoch_id", "csp_lda", 200), "rounds")  # read for the true labels and for the others
    seen = by.where("round = 0").select("subject", F.col("accuracy").alias("seen"))
    p = (F.count_if(F.col("accuracy") >= F.col("seen")) + 1) / (F.count(F.lit(1)) + 1)
    return by.where("round > 0").join(seen, "subject").groupBy(F.col("subject").alias("person"), "seen").agg(p.alias("p"), F.count(F.lit(1)).alias("shuffles"))


@query()
def d37_learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy from the first 25 %, 50 %, 75 % and all of the 25 runs of each person, in five folds of whole runs."""
    f = _folds(spark, sf).withColumn("run", F.floor(F.col("epoch_id") / 10) % 25)
    parts = f.withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(4)))).where(F.col("run") < F.floor(F.col("quarter") * 25 / 4))
    cv = learning.cross_validate(parts.withColumn("subject", F.col("subject") * 4 + F.col("quarter") - 1), "subject", "fold", "y", ["csp_lda"])
    return cv.groupBy(((F.col("subject") % 4 + 1) * 25).alias("percent")).agg((F.sum("correct") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


@query()
def k17_leakage_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy under folds dealt by trial less that under folds of whole runs."""
    f = _folds(spark, sf).withColumn("naive", F.pmod(F.xxhash64("signal"), F.lit(5)).cast("int"))
    score = lambda fold, name: learning.cross_validate(f, "subject", fold, "y", ["csp_lda"]).groupBy("subject").agg((F.sum("correct") / F.sum("n")).alias(name))
    return score("naive", "by_trial").join(score("fold", "by_run"), "subject").withColumn("gap", F.col("by_trial") - F.col("by_run"))


@query()
def k17_overlap_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """What overlap adds: windows of 48 samples every 16, dealt to folds at random or by stretches of ten whose edges are purged.

    leaked: training windows that hold samples of a held-out one, over the random folds; purged folds have none.
    """
    w = stream_windows(spark, sf, 48, 16).select(F.floor(F.col("epoch_id") / 400).alias("subject"), "epoch_id", (F.floor(F.col("epoch_id") / 2) % 2).alias("y"), "signal")
    w = w.withColumns({"naive": F.pmod(F.xxhash64(F.lit(17), "epoch_id"), F.lit(4)).cast("int"), "stretch": (F.floor(F.col("epoch_id") / 10) % 4).cast("int")})
    w = staged(w, "windows")
    score = lambda fold: learning.purged_scores(w, "subject", fold, "y", "epoch_id", 3, "csp_lda")
    sums = [(F.sum("correct") / F.sum("n")).alias("accuracy"), F.sum("shared").alias("shared"), F.sum("purged").alias("purged"), F.sum("n").alias("n")]
    naive = score("naive").where("NOT purge").groupBy("subject").agg(*sums).select("subject", F.col("accuracy").alias("naive"), F.col("shared").alias("leaked"))
    apart = score("stretch").where("purge").groupBy("subject").agg(*sums).select("subject", F.col("accuracy").alias("apart"), "purged", F.col("shared").alias("still_shared"), "n")
    return naive.join(apart, "subject").withColumn("gap", F.col("naive") - F.col("apart"))


@query()
def k6_within_vs_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Each person's second half, learned from the own first half, or from other people (five folds of whole people).

    Models across people are fitted from sums that merge across tasks, so no task holds their trials together.
    """
    e = windows.halves(_folds(spark, sf).drop("fold"), ["subject"], "epoch_id")
    own = learning.cross_validate(e.withColumn("fold", (F.col("half") - 1).cast("int")), "subject", "fold", "y", ["csp_lda"])
    own = own.where("fold = 1").select("subject", F.col("accuracy").alias("within"))
    apart = e.withColumn("apart", F.pmod(F.xxhash64(F.lit(7), "subject"), F.lit(5)).cast("int"))
    found = learning.held_out_csp_lda(apart, "apart", 5, "y").where("half = 2 and predicted is not null")
    across = found.groupBy("subject").agg(F.avg((F.col("predicted") == F.col("y")).cast("double")).alias("across"))
    return own.join(across, "subject", "left")


@query()
def d29_d30_j1_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Tangent features and logistic regression of all people, as a pyspark.ml pipeline: learned on runs 0 to 3, scored on 4."""
    e = epochs(spark, sf).select("epoch_id", (F.floor(F.col("epoch_id") / 10) % 5).alias("fold"), (F.col("label") % 2).cast("double").alias("label"), "signal")
    model = estimators.BUILDERS["riemann_lr"]().fit(e.where("fold < 4"))
    return model.transform(e.where("fold = 4")).select("epoch_id", "label", "prediction")


@query()
def d31_svm(spark: SparkSession, sf: str) -> DataFrame:
    """Linear margins of tangent features with probabilities: learned on runs 0 to 3 (each held out in turn for the sigmoid), scored on 4."""
    e = epochs(spark, sf).select("epoch_id", (F.floor(F.col("epoch_id") / 10) % 5).alias("fold"), (F.col("label") % 2).cast("double").alias("label"), "signal")
    model = estimators.BUILDERS["riemann_svm"]().fit(e.where("fold < 4"))
    return model.transform(e.where("fold = 4")).select("epoch_id", "label", "prediction", "margin", "probability")


@query()
def d42_filter_layer(spark: SparkSession, sf: str) -> DataFrame:
    """finite, alive and positive definite after the band-pass, per trial."""
    import numpy as np

    def check(x: np.ndarray) -> list:
        y = K.zero_phase(K.bandpass(4, 8.0, 30.0, 250.0), x)
        low = np.linalg.eigvalsh(K.covariances(y)).min(axis=1)
        return [{"finite": bool(np.isfinite(t).all()), "alive": bool((t.std(axis=1) > 0).all()), "lowest": float(v)} for t, v in zip(y, low)]

    e = epochs(spark, sf).withColumn("c", signals.batched(check, "struct<finite:boolean,alive:boolean,lowest:double>")("signal"))
    return e.select("epoch_id", "c.finite", "c.alive", (F.col("c.lowest") > 0).alias("definite"))


@query()
def h10_resample(spark: SparkSession, sf: str) -> DataFrame:
    up = signals.batched(lambda x: [list(map(list, t)) for t in K.resample(x, 16)], "array<array<double>>")
    return epochs(spark, sf).select("epoch_id", F.posexplode(up("signal")).alias("ch", "y"))


@query()
def h24_filter_bank_features(spark: SparkSession, sf: str) -> DataFrame:
    """Log-variance features of four spatial filters in each of six bands, side by side."""
    e = epochs(spark, sf).where("label in (0, 1)").select("epoch_id", "label", "signal")
    found = spatial.bank_csp_filters(e, "label", (0, 1), K.MOTOR_BANK)
    return spatial.bank_csp_features(e, found, K.MOTOR_BANK).select("epoch_id", "label", "features")


@query()
def k10_k12_layer_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per person: screening, separability and classifier in one gated table."""
    p = long_epochs(spark, sf).withColumns({"y": F.col("label") % 2, "subject": F.floor(F.col("epoch_id") / 250)}).groupBy("epoch_id", "subject", "y", "ch").agg(C.log_variance(F.var_pop("x")).alias("p"))
    f = stats.anova(p, ["subject", "ch"], "p", "y").groupBy("subject").agg(F.max("f").alias("f"))
    cv = learning.cross_validate(_folds(spark, sf), "subject", "fold", "y", ["csp_lda"]).groupBy("subject").agg((F.sum("correct") / F.sum("n")).alias("accuracy"))
    rows = f.join(cv, "subject", "left")
    stages = rows.select("subject", F.explode(F.array(F.struct(F.lit(1).alias("stage"), F.when(F.col("f") > 1, "PASS").otherwise("FAIL").alias("status")), F.struct(F.lit(2).alias("stage"), F.when(F.col("accuracy") > 0.5, "PASS").otherwise("FAIL").alias("status")))).alias("s")).select("subject", "s.*")
    return quality.gates(stages, ["subject"], "stage", "status").select("subject", "stage", "gated", "first_fail")




@query()
def h26_model_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of windows to a command and its confidence, or to no action below the threshold of the session's idle windows."""
    s = stream_windows(spark, sf).select("epoch_id", F.floor(F.col("epoch_id") / 50).alias("session"), (F.col("epoch_id") % 3 == 0).alias("idle"), signals.fbcca_scores(F.col("signal"), [15.0, 20.0], 250.0, [0, 1, 2, 3, 4]).alias("s"))
    best = F.array_max("s")
    rows = s.select("epoch_id", "session", "idle", best.alias("confidence"), F.element_at(F.array(F.lit("left"), F.lit("right")), F.array_position("s", best).cast("int")).alias("name"), F.lit(False).alias("artifact"))
    limit = stats.idle_threshold(rows, ["session"], "confidence", "idle", "artifact")
    gated = rows.join(limit, "session", "left")
    return gated.select("epoch_id", "confidence", C.gate(F.col("name"), F.col("confidence"), F.coalesce("threshold", F.lit(0.0))).alias("command"))


@query()
def j2_k8_k13_task_set(spark: SparkSession, sf: str) -> DataFrame:
    """All named pipelines on sessions held out, after screening, with the winner of each person."""
    st = epochs(spark, sf).select("epoch_id", "subject", "label", F.posexplode("signal").alias("channel", "x"))
    st = st.select("epoch_id", "subject", "label", "channel", *quality.signal_stats(F.col("x")))
    kept = quality.masked_if_enough(quality.screen(st, ["epoch_id", "subject"], "label", _LIMITS), ["subject"]).select("epoch_id")
    f = _folds(spark, sf).join(kept, "epoch_id", "left_semi")
    return stats.cv_summary(learning.cross_validate(f, "subject", "fold", "y", learning.MOTOR), ["subject"], "pipeline", "accuracy")


@query()
def k7_k8_k10_models(spark: SparkSession, sf: str) -> DataFrame:
    """The life of a person's model: the winner of the cross-validation is fitted anew on all runs, saved, read again and used.

    delta: how its cross-validated accuracy differs from that of the first three runs alone; change as in the history.
    """
    f = _folds(spark, sf)
    score = lambda rows: stats.cv_summary(learning.cross_validate(rows, "subject", "fold", "y", ["csp_lda", "riemann_lda"]), ["subject"], "pipeline", "accuracy").where("winner")
    now, before = score(f), score(f.where("fold < 3")).select("subject", F.col("mean").alias("before"))
    path = scratch_path(spark, "models")
    learning.refit(f, now, "subject", "y").write.parquet(path)
    used = learning.applied(f, spark.read.parquet(path), "subject")
    seen = used.groupBy("subject", "pipeline").agg(F.avg((F.col("predicted") == F.col("y")).cast("double")).alias("on_own_trials"), F.count(F.lit(1)).alias("trials"))
    delta = F.col("mean") - F.col("before")
    change = F.when(delta.isNull(), "first").when(delta > 0.005, "improved").when(delta < -0.005, "declined").otherwise("unchanged")
    return seen.join(now.select("subject", F.col("mean").alias("accuracy"), "mean"), "subject").join(before, "subject", "left").select("subject", "pipeline", "trials", "accuracy", "on_own_trials", F.coalesce(delta, F.lit(0.0)).alias("delta"), change.alias("change"))


@query(f"WITH {EPOCHS}, p AS (SELECT epoch_id, label % 2 AS y, ch, ln(var_pop(x) + 1e-12) AS p FROM epochs GROUP BY 1, 2, 3), c AS (SELECT ch, y, count(*) AS n, avg(p) AS m, var_pop(p) AS v FROM p GROUP BY 1, 2), g AS (SELECT ch, sum(n * m) / sum(n) AS g FROM c GROUP BY 1), f AS (SELECT ch, (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM c JOIN g USING (ch) GROUP BY 1) SELECT max_by(ch, f) AS channel, round(max(f), 5) AS f, count(*) AS channels FROM f")
def f5_best_channel(spark: SparkSession, sf: str) -> DataFrame:
    """The channel whose log power tells the classes apart best."""
    p = long_epochs(spark, sf).withColumn("y", F.col("label") % 2).groupBy("epoch_id", "y", "ch").agg(C.log_variance(F.var_pop("x")).alias("v"))
    return stats.anova(p, ["ch"], "v", "y").agg(F.max_by("ch", "f").alias("channel"), F.round(F.max("f"), 5).alias("f"), F.count(F.lit(1)).alias("channels"))


@query(f"WITH {EPOCHS}, b AS (SELECT epoch_id, ch, k AS bin, sum(x * cos(2 * pi() * ((k * s) % 8) / 8)) AS re, sum(x * sin(2 * pi() * ((k * s) % 8) / 8)) AS im FROM epochs, range(5) t(k) GROUP BY 1, 2, 3), r AS (SELECT epoch_id, ch, sum(CASE WHEN bin = 1 THEN 4 * (re * re + im * im) / 64 ELSE 0 END) AS target, avg(CASE WHEN bin = 2 THEN 4 WHEN bin = 3 THEN 4 WHEN bin = 4 THEN 1 END * (re * re + im * im) / 64) AS reference FROM b GROUP BY 1, 2) SELECT epoch_id, ch, round(target / greatest(reference, 1e-12), 4) AS ratio, target < 0.1 * reference AS low_power FROM r")
def d20_target_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Power of the target bin over the mean of the bins above it, and whether the target is too weak to use."""
    s = signals.spectrum(long_epochs(spark, sf), ["epoch_id", "ch"], "s", "x", 8, 250.0).withColumn("p", F.col("amplitude") ** 2)
    r = s.groupBy("epoch_id", "ch").agg(F.sum(F.when(F.col("bin") == 1, F.col("p")).otherwise(0.0)).alias("target"), F.avg(F.when(F.col("bin") > 1, F.col("p"))).alias("reference"))
    return r.select("epoch_id", "ch", F.round(F.col("target") / F.greatest("reference", F.lit(1e-12)), 4).alias("ratio"), (F.col("target") < 0.1 * F.col("reference")).alias("low_power"))


@query(f"WITH {DECISIONS}, i AS (SELECT session, count(*) AS idle, count_if(command IS NOT NULL) AS fired FROM decisions WHERE predicted NOT IN ('signup', 'purchase') AND NOT is_artifact GROUP BY 1) SELECT session, idle, fired, round(fired / (idle / 60.0), 6) AS per_idle_minute FROM i", longs="fired")
def d46_false_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Commands in idle windows (a second each), per minute of them."""
    d = decisions(spark, sf).where(~F.col("predicted").isin("signup", "purchase") & ~F.col("is_artifact"))
    i = d.groupBy("session").agg(F.count(F.lit(1)).alias("idle"), F.count_if(F.col("command").isNotNull()).alias("fired"))
    return i.select("session", "idle", "fired", F.round(F.col("fired") / (F.col("idle") / 60.0), 6).alias("per_idle_minute"))


@query("WITH l AS (SELECT c_custkey, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY 1) SELECT c_custkey, last FROM l WHERE last IS NULL OR last + INTERVAL 30 DAY <= TIMESTAMP '1998-06-01'")
def a17_k15_due_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Who has agreed to an export (a positive balance stands for it) and is due for one."""
    c, o = table(spark, sf, "customer").where("c_acctbal > 0"), table(spark, sf, "orders")
    last = c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.max("o_orderdate").alias("last"))
    return last.where(F.col("last").isNull() | (F.col("last") + F.make_dt_interval(F.lit(30)) <= F.lit("1998-06-01").cast("timestamp_ntz")))


@query("WITH own AS (SELECT user_id % 10 AS person, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT *, label IN ('signup', 'purchase') OR (label = 'view' AND person < 5) AS allowed FROM own) SELECT person, count(*) AS labels, string_agg(label, ',' ORDER BY label) FILTER (NOT allowed) AS foreign_labels, CASE WHEN bool_and(allowed) THEN 'ACCEPT' ELSE 'REFUSE' END AS verdict FROM a GROUP BY 1")
def b5_foreign_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Personal files with labels that the person's task set lacks are refused."""
    own = table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("person"), F.col("event_type").alias("label")).count()
    allowed = F.col("label").isin("signup", "purchase") | ((F.col("label") == "view") & (F.col("person") < 5))
    odd = F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(~allowed, F.col("label")))), ","), F.lit(""))
    return own.groupBy("person").agg(F.count(F.lit(1)).alias("labels"), odd.alias("foreign_labels"), F.when(F.bool_and(allowed), "ACCEPT").otherwise("REFUSE").alias("verdict"))
