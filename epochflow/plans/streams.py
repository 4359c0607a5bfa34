"""Windows, blocks, screening and joins by time over the sample stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochflow.functions import columns as C
from epochflow.operators import joins, quality, stats, windows
from epochflow.plans.base import DECISIONS, EPOCHS, SIGNAL, decisions, epochs, long_epochs, query, rounded, signal, table
from epochflow.sources.scratch import staged

_HOPS = f"WITH {SIGNAL}, w AS (SELECT channel, k, s.i AS i, s.x AS x FROM signal s, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((s.i - 47) / 16.0) AS BIGINT)), s.i // 16 + 1)) AS k)), full_w AS (SELECT channel, k FROM w GROUP BY 1, 2 HAVING count(*) = 48)"


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.hop_windows(signal(spark, sf), ["channel"], "i", "x", 48, 16)


@query(f"{_HOPS}, st AS (SELECT channel, k, max(abs(x - m)) AS peak, stddev_pop(x) AS std, max(j) AS jump FROM (SELECT *, avg(x) OVER (PARTITION BY channel, k) AS m, abs(x - lag(x) OVER (PARTITION BY channel, k ORDER BY i)) AS j FROM w SEMI JOIN full_w USING (channel, k)) GROUP BY 1, 2) SELECT channel, count(*) AS windows, count_if(peak <= 400 AND std >= 0.05 AND jump <= 75) AS kept, count_if(peak > 400) AS amplitude, count_if(std < 0.05) AS flat, count_if(jump > 75) AS jump FROM st GROUP BY 1", longs="kept amplitude flat jump")
def m0_window_screen(spark: SparkSession, sf: str) -> DataFrame:
    st = _windows(spark, sf).select("channel", "k", *quality.signal_stats(F.col("signal")))
    lim = quality.LIMITS
    bad = {"amplitude": F.col("peak") > lim["amplitude"], "flat": F.col("std") < lim["flat"], "jump": F.col("jump") > lim["jump"]}
    return st.withColumns({f"_{n}": c for n, c in bad.items()}).groupBy("channel").agg(F.count(F.lit(1)).alias("windows"), F.count_if(~(F.col("_amplitude") | F.col("_flat") | F.col("_jump"))).alias("kept"), *[F.count_if(F.col(f"_{n}")).alias(n) for n in bad])


@query(f"{_HOPS} SELECT channel, k, min(i) AS start, round(sum(x), 6) AS total, count(*) AS n FROM w SEMI JOIN full_w USING (channel, k) GROUP BY 1, 2")
def i1_hop_windows(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate("signal", F.lit(0.0), lambda a, x: a + x)
    return _windows(spark, sf).select("channel", "k", "start", F.round(total, 6).alias("total"), F.size("signal").cast("bigint").alias("n"))


@query(f"WITH {SIGNAL} SELECT channel, i // 48 AS k, round(sum(x), 6) AS total FROM signal GROUP BY 1, 2 HAVING count(*) = 48")
def i2_tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate("signal", F.lit(0.0), lambda a, x: a + x)
    return windows.tumbling_windows(signal(spark, sf), ["channel"], "i", "x", 48).select("channel", "k", F.round(total, 6).alias("total"))


@query(f"WITH {SIGNAL}, n AS (SELECT channel, count(*) AS c FROM signal GROUP BY 1) SELECT channel, count(*) AS n, round(sum(x), 6) AS total, round(sum(x * i), 4) AS moment FROM signal JOIN n USING (channel) WHERE i < 48 + 16 * ((c - 48) // 16) GROUP BY 1")
def i3_stitch(spark: SparkSession, sf: str) -> DataFrame:
    whole = windows.stitch(_windows(spark, sf), ["channel"], 16)
    return whole.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 6).alias("total"), F.round(F.sum(F.col("x") * F.col("i")), 4).alias("moment"))


@query(f"WITH {DECISIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC) AS back FROM decisions) SELECT session, count_if(back <= 2) AS kept, count_if(back > 2) AS dropped, max(n) AS newest FROM r GROUP BY 1", longs="kept dropped")
def f3_i4_keep_newest(spark: SparkSession, sf: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("session").orderBy(F.col("n").desc()))
    return decisions(spark, sf).withColumn("back", back).groupBy("session").agg(F.count_if(F.col("back") <= 2).alias("kept"), F.count_if(F.col("back") > 2).alias("dropped"), F.max("n").alias("newest"))


@query(f"WITH {DECISIONS} SELECT session, t_ms // 250 AS slot, max_by(n, t_ms) AS n FROM decisions GROUP BY 1, 2")
def i13_throttle(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).groupBy("session", F.floor(F.col("t_ms") / 250).alias("slot")).agg(F.max_by("n", "t_ms").alias("n"))


@query(f"WITH {SIGNAL}, b AS (SELECT *, i // 100 AS trial FROM signal) SELECT channel, trial, round(max(abs(x - m)), 6) AS peak, round(stddev_pop(x), 6) AS std, round(coalesce(max(j), 0), 6) AS jump, count(*) AS n FROM (SELECT *, avg(x) OVER (PARTITION BY channel, trial) AS m, abs(x - lag(x) OVER (PARTITION BY channel, trial ORDER BY i)) AS j FROM b) GROUP BY 1, 2")
def d1_trial_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf).withColumn("trial", F.floor(F.col("i") / 100))
    return rounded(quality.long_stats(rows, ["channel", "trial"], "i", "x"), "peak", "std", "jump")


_STATS = f"WITH {EPOCHS}, st AS (SELECT epoch_id, label, subject, ch AS channel, max(abs(x - m)) AS peak, stddev_pop(x) AS std, max(j) AS jump FROM (SELECT *, avg(x) OVER (PARTITION BY epoch_id, ch) AS m, abs(x - lag(x) OVER (PARTITION BY epoch_id, ch ORDER BY s)) AS j FROM epochs) GROUP BY 1, 2, 3, 4), p AS (SELECT *, ln(std * std + 1e-12) AS p FROM st), md AS (SELECT label, channel, quantile_cont(p, 0.5) AS m, count(*) AS n FROM p GROUP BY 1, 2), dv AS (SELECT p.*, m, n, abs(p.p - m) AS d FROM p JOIN md USING (label, channel)), mad AS (SELECT label, channel, quantile_cont(d, 0.5) AS mad FROM dv GROUP BY 1, 2), z AS (SELECT dv.*, CASE WHEN mad > 0 AND n >= 4 THEN 0.6745 * (p - m) / mad ELSE 0 END AS z FROM dv JOIN mad USING (label, channel)), scr AS (SELECT epoch_id, label, subject, bool_or(peak > 0.42) AS amplitude, bool_or(std < 0.04) AS flat, bool_or(jump > 0.7) AS jump, bool_or(abs(z) > 4.0) AS outlier FROM z GROUP BY 1, 2, 3)"
#: Limits that bind on the scale of these epochs.
_LIMITS = {"amplitude": 0.42, "flat": 0.04, "jump": 0.7}


def _channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = epochs(spark, sf).select("epoch_id", "label", "subject", F.posexplode("signal").alias("channel", "x"))
    return rows.select("epoch_id", "label", "subject", "channel", *quality.signal_stats(F.col("x")))


def _screened(spark: SparkSession, sf: str) -> DataFrame:
    return quality.screen(_channel_stats(spark, sf), ["epoch_id", "subject"], "label", _LIMITS)


@query(f"{_STATS} SELECT epoch_id, label, concat_ws(',', CASE WHEN amplitude THEN 'amplitude' END, CASE WHEN flat THEN 'flat' END, CASE WHEN jump THEN 'jump' END, CASE WHEN outlier THEN 'outlier' END) AS reasons, NOT (amplitude OR flat OR jump OR outlier) AS keep FROM scr")
def d2_b21_screen_trials(spark: SparkSession, sf: str) -> DataFrame:
    return _screened(spark, sf).select("epoch_id", "label", F.array_join("reasons", ",").alias("reasons"), "keep")


@query(f"{_STATS} SELECT label, count(*) AS trials, count_if(NOT (amplitude OR flat OR jump OR outlier)) AS kept FROM scr GROUP BY 1", longs="kept")
def d6_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _screened(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("trials"), F.count_if("keep").alias("kept"))


@query(f"WITH {EPOCHS}, st AS (SELECT epoch_id, ch AS channel, max(abs(x - m)) AS peak, stddev_pop(x) AS std FROM (SELECT *, avg(x) OVER (PARTITION BY epoch_id, ch) AS m FROM epochs) GROUP BY 1, 2) SELECT channel, round(quantile_cont(peak, 0.5), 6) AS median_peak, round(quantile_cont(peak, 0.95), 6) AS p95_peak, round(max(peak), 6) AS max_peak, round(quantile_cont(std, 0.5), 6) AS median_std, round(min(std), 6) AS min_std, round(max(std), 6) AS max_std, count_if(peak > 0.42) AS failing FROM st GROUP BY 1", longs="failing")
def d7_channel_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    st = staged(_channel_stats(spark, sf), "channel_stats")
    out = st.groupBy("channel").agg(F.max("peak").alias("max_peak"), F.min("std").alias("min_std"), F.max("std").alias("max_std"), F.count_if(F.col("peak") > _LIMITS["amplitude"]).alias("failing"))
    peak = stats.exact_quantile(st, ["channel"], "peak", [0.5, 0.95]).select("channel", F.col("quantiles")[0].alias("median_peak"), F.col("quantiles")[1].alias("p95_peak"))
    std = stats.exact_quantile(st, ["channel"], "std", [0.5]).select("channel", F.col("quantiles")[0].alias("median_std"))
    out = out.join(peak, "channel").join(std, "channel")
    return rounded(out, "median_peak", "p95_peak", "max_peak", "median_std", "min_std", "max_std")


@query(f"{_STATS}, v AS (SELECT subject, count(*) AS trials, count_if(NOT (amplitude OR flat OR jump OR outlier)) AS kept, count_if(amplitude) AS a, count_if(flat) AS f, count_if(jump) AS j, count_if(outlier) AS o FROM scr GROUP BY 1) SELECT subject, trials, kept, round(1 - kept / trials, 6) AS drop_rate, CASE WHEN a > 0 THEN 'amplitude' WHEN f > 0 THEN 'flat' WHEN j > 0 THEN 'jump' WHEN o > 0 THEN 'outlier' END AS first_reason, CASE WHEN kept > 0 AND 1 - kept / trials <= 0.33 THEN 'ACCEPT' ELSE 'REJECT' END AS verdict FROM v", longs="kept")
def d8_k11_recording_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.recording_verdict(_screened(spark, sf), ["subject"]).select("subject", "trials", "kept", "drop_rate", "first_reason", "verdict"), "drop_rate")


@query(f"{_STATS}, k AS (SELECT *, NOT (amplitude OR flat OR jump OR outlier) AS keep FROM scr), c AS (SELECT *, count_if(keep) OVER (PARTITION BY subject) AS n FROM k) SELECT subject, count(*) AS used FROM c WHERE keep OR n < 8 GROUP BY 1")
def b7_mask_if_enough(spark: SparkSession, sf: str) -> DataFrame:
    return quality.masked_if_enough(_screened(spark, sf), ["subject"]).groupBy("subject").agg(F.count(F.lit(1)).alias("used"))


@query(f"{_STATS}, c AS (SELECT subject, label, count_if(NOT (amplitude OR flat OR jump OR outlier)) AS kept, count(*) AS trials FROM scr GROUP BY 1, 2), t AS (SELECT subject, min(kept) AS least, sum(kept) AS kept, sum(trials) AS trials FROM c GROUP BY 1) SELECT subject, CASE WHEN kept = 0 THEN 'NOT_READY: nothing kept' WHEN 1 - kept / trials > 0.33 THEN 'NOT_READY: too many dropped' WHEN least < 8 THEN 'NOT_READY: too few of a class' ELSE 'READY' END AS readiness FROM t")
def d40_readiness(spark: SparkSession, sf: str) -> DataFrame:
    c = _screened(spark, sf).groupBy("subject", "label").agg(F.count_if("keep").alias("kept"), F.count(F.lit(1)).alias("trials"))
    t = c.groupBy("subject").agg(F.min("kept").alias("least"), F.sum("kept").alias("kept"), F.sum("trials").alias("trials"))
    verdict = F.when(F.col("kept") == 0, "NOT_READY: nothing kept").when(1 - F.col("kept") / F.col("trials") > quality.MOST_DROPPED, "NOT_READY: too many dropped").when(F.col("least") < 8, "NOT_READY: too few of a class").otherwise("READY")
    return t.select("subject", verdict.alias("readiness"))


@query(f"WITH {SIGNAL}, w AS (SELECT channel, i // 48 AS k, max(abs(x - m)) AS peak FROM (SELECT *, avg(x) OVER (PARTITION BY channel, i // 48) AS m FROM signal) GROUP BY 1, 2 HAVING count(*) = 48) SELECT channel, count(*) AS windows, count_if(peak <= 400) AS kept, count_if(peak > 400) / count(*) <= 0.33 AS passed FROM w GROUP BY 1", longs="kept")
def d19_continuous_screen(spark: SparkSession, sf: str) -> DataFrame:
    st = windows.tumbling_windows(signal(spark, sf), ["channel"], "i", "x", 48).select("channel", *quality.signal_stats(F.col("signal")))
    return st.groupBy("channel").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("peak") <= 400).alias("kept"), (F.count_if(F.col("peak") > 400) / F.count(F.lit(1)) <= 0.33).alias("passed"))


@query(f"WITH {SIGNAL} SELECT channel, i, round(x - lag(x) OVER (PARTITION BY channel ORDER BY i), 6) AS step FROM signal")
def e5_e6_first_difference(spark: SparkSession, sf: str) -> DataFrame:
    s = windows.chunked(signal(spark, sf), "i", 65_536, before=1)
    step = F.col("x") - F.lag("x").over(Window.partitionBy("channel", "chunk").orderBy("i"))
    return s.select("channel", "i", "own", F.round(step, 6).alias("step")).where("own").drop("own")


@query(f"WITH {SIGNAL} SELECT channel, i, round(avg(x) OVER w, 6) AS mean FROM signal WINDOW w AS (PARTITION BY channel ORDER BY i ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 16")
def e10_last_samples(spark: SparkSession, sf: str) -> DataFrame:
    s = windows.chunked(signal(spark, sf), "i", 65_536, before=15)
    s = s.select("channel", "i", "own", windows.last_n("x", ["channel", "chunk"], "i", 16).alias("last"))
    return s.where("own and last is not null").select("channel", "i", F.round(F.aggregate("last", F.lit(0.0), lambda a, x: a + x) / 16, 6).alias("mean"))


_BLOCKS = f"{DECISIONS}, c AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN predicted IS DISTINCT FROM lag(predicted) OVER (PARTITION BY session ORDER BY n) THEN 1 ELSE 0 END AS ch FROM decisions), b AS (SELECT *, sum(ch) OVER (PARTITION BY session ORDER BY n) AS block FROM c)"


@query(f"WITH {_BLOCKS} SELECT session, block, min(n) AS first, count(*) AS n, any_value(predicted) AS label FROM b GROUP BY 1, 2", longs="block")
def e1_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = windows.block_ids(decisions(spark, sf), ["session"], "n", "predicted")
    return b.groupBy("session", "block").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("n"), F.first("predicted").alias("label"))


_HUNDREDS = "h AS (SELECT session, n, (n - 1) // 20 AS block FROM decisions)"


@query(f"WITH {DECISIONS}, {_HUNDREDS}, p AS (SELECT *, ntile(3) OVER (PARTITION BY session, block ORDER BY n) AS part FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY session, block, part ORDER BY n) AS pos FROM p) SELECT session, block, part, count(*) AS n, min(n) AS first FROM r WHERE part = 1 OR pos > 2 GROUP BY 1, 2, 3")
def e2_e4_split_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = decisions(spark, sf).select("session", "n", F.floor((F.col("n") - 1) / 20).alias("block"))
    return windows.split_blocks(b, ["session"], "block", "n", 3, 2).groupBy("session", "block", "part").agg(F.count(F.lit(1)).alias("cnt"), F.min("n").alias("first")).withColumnRenamed("cnt", "n")


@query(f"WITH {DECISIONS}, i AS (SELECT *, n - row_number() OVER (PARTITION BY session, command ORDER BY n) AS g FROM decisions), r AS (SELECT *, row_number() OVER (PARTITION BY session, command, g ORDER BY n) AS pos FROM i) SELECT session, count_if(command IS NOT NULL AND pos % 2 = 0) AS fired FROM r GROUP BY 1", longs="fired")
def e3_debounce(spark: SparkSession, sf: str) -> DataFrame:
    return windows.debounced(decisions(spark, sf), ["session"], "n", "command", 2).groupBy("session").agg(F.count_if("fired").alias("fired"))


@query("WITH g AS (SELECT vec_id % 10 AS subject, label, count(*) AS n FROM embeddings GROUP BY 1, 2), k AS (SELECT *, concat(label, '-', subject) AS grp FROM g) SELECT label, subject, (row_number() OVER (PARTITION BY label ORDER BY md5(concat('7|', grp)), grp) - 1) % 5 AS fold FROM k")
def e8_k2_grouped_folds(spark: SparkSession, sf: str) -> DataFrame:
    g = epochs(spark, sf).groupBy("subject", "label").count().withColumn("grp", F.concat_ws("-", "label", "subject"))
    return windows.grouped_folds(g, "label", "grp", 5, 7).select("label", "subject", F.col("fold").cast("bigint").alias("fold"))


@query("WITH h AS (SELECT vec_id % 10 AS subject, vec_id, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) AS pos, count(*) OVER (PARTITION BY vec_id % 10) AS n FROM embeddings) SELECT subject, CASE WHEN pos <= n // 2 THEN 1 ELSE 2 END AS half, count(*) AS n, min(vec_id) AS first FROM h GROUP BY 1, 2")
def e9_halves(spark: SparkSession, sf: str) -> DataFrame:
    return windows.halves(epochs(spark, sf), ["subject"], "epoch_id").groupBy("subject", "half").agg(F.count(F.lit(1)).alias("n"), F.min("epoch_id").alias("first"))


@query(f"WITH {DECISIONS} SELECT session, n, t_ms - max(CASE WHEN predicted = 'purchase' THEN t_ms END) OVER (PARTITION BY session ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS elapsed FROM decisions")
def e11_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("session").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return decisions(spark, sf).select("session", "n", (F.col("t_ms") - F.max(F.when(F.col("predicted") == "purchase", F.col("t_ms"))).over(w)).alias("elapsed"))


@query("SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 4 AS value FROM customer")
def e12_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sample_index(table(spark, sf, "customer"), ["c_nationkey"], "c_custkey").select("c_custkey", (F.col("i") % 4).alias("value"))


# Joins by time

@query(f"WITH {SIGNAL}, cues AS (SELECT channel, i AS start FROM signal WHERE x > 150), s AS (SELECT c.channel, c.start, count(*) AS n, sum(s.x) AS total FROM cues c JOIN signal s ON s.channel = c.channel AND s.i >= c.start AND s.i < c.start + 24 GROUP BY 1, 2) SELECT channel, start, round(total, 6) AS total FROM s WHERE n = 24")
def c1_j7_cut_epochs(spark: SparkSession, sf: str) -> DataFrame:
    s = signal(spark, sf)
    cues = s.where("x > 150").select("channel", F.col("i").alias("start"))
    return joins.cut_epochs(s, cues, ["channel"], 24).select("channel", "start", F.round(F.aggregate("signal", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_ASOF = f"WITH {DECISIONS}, p AS (SELECT session, t_ms, n FROM decisions WHERE predicted = 'signup'), f AS (SELECT session, t_ms, n FROM decisions WHERE predicted = 'purchase')"


@query(f"{_ASOF} SELECT f.session, f.n, p.n AS cue FROM f ASOF LEFT JOIN p ON f.session = p.session AND f.t_ms >= p.t_ms")
def c2_as_of_cue(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf)
    f, p = (d.where(F.col("predicted") == k).select("session", "t_ms", "n") for k in ("purchase", "signup"))
    return joins.as_of(f, p.withColumnRenamed("n", "cue"), ["session"], "t_ms", "t_ms", ["cue"]).select("session", "n", "cue")


@query(f"{_ASOF}, a AS (SELECT f.session, f.n, p.n AS cue FROM f ASOF JOIN p ON f.session = p.session AND f.t_ms >= p.t_ms) SELECT session, cue, min(n) AS feedback FROM a GROUP BY 1, 2")
def c7_first_feedback_wins(spark: SparkSession, sf: str) -> DataFrame:
    return joins.first_per(c2_as_of_cue(spark, sf).where("cue is not null"), ["session", "cue"], "n").select("session", "cue", F.col("n").alias("feedback"))


@query(f"WITH {DECISIONS}, q AS (SELECT session, t_ms FROM decisions WHERE predicted = 'error') SELECT d.session, count(*) AS open_windows FROM decisions d WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.session = d.session AND d.t_ms >= q.t_ms AND d.t_ms < q.t_ms + 3200000) GROUP BY 1")
def i9_feedback_suppression(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf)
    marks = d.where("predicted = 'error'").select("session", F.col("t_ms").alias("mark"))
    last = joins.as_of(d, marks, ["session"], "t_ms", "mark", ["mark"])
    return last.where("mark is null or t_ms >= mark + 3200000").groupBy("session").agg(F.count(F.lit(1)).alias("open_windows"))


@query("WITH w AS (SELECT doc_id, n_chars / 100.0 AS want FROM documents), t AS (SELECT DISTINCT round(value, 2) AS have FROM events) SELECT doc_id, (SELECT have FROM t WHERE abs(have - want) <= 0.05 ORDER BY abs(have - want), have LIMIT 1) AS have FROM w")
def c5_h14_nearest_frequency(spark: SparkSession, sf: str) -> DataFrame:
    want = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 100.0).alias("want"))
    have = table(spark, sf, "events").select(F.round("value", 2).alias("have")).distinct()
    return joins.nearest_within(want, have, "want", "have", 0.05).select("doc_id", "have")


@query("WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id, role) AS c FROM conversations) SELECT a.conv_id, a.turn, b.turn AS log_turn FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.k = b.k AND a.c = b.c WHERE a.role = 'user' AND b.role = 'assistant'")
def c6_d3_positional(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations")
    a = t.where("role = 'user'").select("conv_id", "turn")
    b = t.where("role = 'assistant'").select("conv_id", F.col("turn").alias("log_turn"))
    return joins.positional(a, b, ["conv_id"], "turn", "log_turn").select("conv_id", "turn", "log_turn")


@query(f"WITH {SIGNAL}, t AS (SELECT channel, i, x FROM signal) SELECT a.channel AS a, b.channel AS b, round(corr(a.x, b.x), 6) AS r, count(*) AS n FROM t a JOIN t b ON a.i = b.i AND a.channel < b.channel GROUP BY 1, 2")
def c9_channel_correlation(spark: SparkSession, sf: str) -> DataFrame:
    wide = signal(spark, sf).select("i", F.struct("channel", "x").alias("c")).groupBy("i").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    pairs = wide.select(F.explode("cs").alias("p"), "cs").select("p", F.explode(F.filter("cs", lambda q: q["channel"] > F.col("p.channel"))).alias("q"))
    return pairs.groupBy(F.col("p.channel").alias("a"), F.col("q.channel").alias("b")).agg(F.round(F.corr("p.x", "q.x"), 6).alias("r"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {EPOCHS} SELECT epoch_id, s, round(max(CASE WHEN ch = 6 THEN x END), 6) AS o1, round(max(CASE WHEN ch = 7 THEN x END), 6) AS o2 FROM epochs GROUP BY 1, 2")
def b1_pick_channels(spark: SparkSession, sf: str) -> DataFrame:
    two = epochs(spark, sf).select("epoch_id", C.pick_channels(F.col("signal"), [6, 7]).alias("p"))
    return rounded(two.select("epoch_id", F.posexplode(F.arrays_zip(F.col("p")[0].alias("o1"), F.col("p")[1].alias("o2"))).alias("s", "z")).select("epoch_id", "s", F.col("z.o1").alias("o1"), F.col("z.o2").alias("o2")), "o1", "o2")


@query("SELECT user_id, round(sum(x), 6) AS total, count(*) AS n FROM (SELECT user_id, unnest(CASE WHEN len(v) >= 40 THEN v[1:40] ELSE list_concat(v, list_transform(range(40 - len(v)), lambda k: v[-1])) END) AS x FROM (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1)) GROUP BY 1")
def b2_crop_or_pad(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    out = v.select("user_id", F.explode(C.crop_or_pad(F.transform("s", lambda x: x["value"]), 40)).alias("x"))
    return out.groupBy("user_id").agg(F.round(F.sum("x"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {EPOCHS} SELECT ch, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS scale FROM epochs GROUP BY 1")
def d43_channel_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    sd = F.stddev_pop("x")
    return long_epochs(spark, sf).groupBy("ch").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.when(sd < 1e-8, 1.0).otherwise(sd), 6).alias("scale"))


@query("SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM embeddings GROUP BY 1")
def d43_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse-frequency weights: rows / (classes * rows of the class)."""
    n = epochs(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("_all") / (F.col("_classes") * F.col("n")), 6).alias("weight"))  # one row of totals
