"""Contracts between recordings, models and profiles; reports in several stages; folds that balance whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochflow.functions import columns as C
from epochflow.functions import dims
from epochflow.functions.text import tail, wrapped
from epochflow.operators import information, joins, learning, quality, signals, stats
from epochflow.plans.analysis import _folds, d11_d12_threshold_sweep
from epochflow.plans.base import DECISIONS, EPOCHS, SIGNAL, decisions, epochs, long_epochs, query, rounded, signal, stream_windows, table
from epochflow.plans.relational import _LABELS, _labelled
from epochflow.plans.streams import _LIMITS, _screened
from epochflow.sources.scratch import scratch_path

_LINES = "CASE WHEN {t} IS NOT NULL THEN list_transform(range(0, greatest(length({t}) - 1, 0) // {w} + 1), lambda k: substring({t}, k * {w} + 1, {w})) END"


@query(f"WITH l AS (SELECT conv_id, turn, {_LINES.format(t='ltrim(text)', w=40)} AS lines FROM conversations) SELECT conv_id, turn, CAST(unnest(range(0, len(lines))) AS INT) AS at, unnest(lines) AS line FROM l WHERE lines IS NOT NULL")
def h4_word_wrap(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "conversations").select("conv_id", "turn", wrapped(F.col("text"), 40).alias("lines"))
    return lines.select("conv_id", "turn", F.posexplode("lines").alias("at", "line"))


@query(f"WITH l AS (SELECT conv_id, turn, {_LINES.format(t='t', w=38)} AS lines FROM (SELECT conv_id, turn, ltrim(text || '_') AS t FROM conversations)) SELECT conv_id, turn, array_to_string(lines[greatest(len(lines) - 3, 1):], chr(10)) AS shown FROM l")
def f6_shown_lines(spark: SparkSession, sf: str) -> DataFrame:
    """What a panel of four lines of 38 shows of a text and its cursor."""
    lines = wrapped(F.concat("text", F.lit("_")), 38)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(tail(lines, 4), "\n").alias("shown"))


@query(f"WITH {SIGNAL}, c AS (SELECT channel, i // 400 AS block, (i // 100) % 4 AS target, i % 100 AS t, x FROM signal WHERE channel IN ('view', 'click', 'error')), m(target, class) AS (VALUES (0, 0), (2, 1), (3, 2)) SELECT channel, class, block, count(*) AS samples, round(sum(x), 5) AS total, min_by(x, t) AS first FROM c JOIN m USING (target) WHERE t >= 16 AND t < 16 + 75 GROUP BY 1, 2, 3 HAVING count(*) = 75")
def a5_target_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Trials of a (channel, time, target, block) array: classes by a map of targets, 75 samples from 16 after the cue on, three channels.

    Targets that the map lacks and trials that are too short are left out.
    """
    of = spark.createDataFrame([(0, 0), (2, 1), (3, 2)], "target long, class int")
    i = F.col("i")
    s = signal(spark, sf).where(F.col("channel").isin("view", "click", "error")).select("channel", F.floor(i / 400).alias("block"), (F.floor(i / 100) % 4).alias("target"), (i % 100).alias("t"), "x")
    cut = s.where("t >= 16 and t < 16 + 75").join(F.broadcast(of), "target").groupBy("channel", "class", "block")
    return cut.agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("x"), 5).alias("total"), F.min_by("x", "t").alias("first")).where("samples = 75")


#: What a run's codes mean: hands in even runs, feet and both hands in odd ones.
_CODES = [(0, "T0", "idle", "idle"), (0, "T1", "left_hand", "hand"), (0, "T2", "right_hand", "hand"), (1, "T0", "idle", "idle"), (1, "T1", "both_hands", "hand"), (1, "T2", "both_feet", "feet")]
_CODE_ROWS = ", ".join(f"({k}, '{c}', '{i}', '{g}')" for k, c, i, g in _CODES)


@query(f"WITH {SIGNAL}, cue AS (SELECT channel, i AS start, i // 100 AS run, concat('T', event_id % 3) AS code FROM signal WHERE x > 150 AND channel IN ('view', 'click')), m(parity, code, intent, category) AS (VALUES {_CODE_ROWS}), e AS (SELECT c.channel, c.start, c.run, c.code, sum(s.x) AS total FROM cue c JOIN signal s ON s.channel = c.channel AND s.i >= c.start + 2 AND s.i < c.start + 26 GROUP BY 1, 2, 3, 4 HAVING count(*) = 24), l AS (SELECT e.*, intent, category FROM e JOIN m ON m.code = e.code AND m.parity = e.run % 2), k AS (SELECT DISTINCT channel, category FROM l WHERE category <> 'idle'), r AS (SELECT channel, start, run, code, total, intent, category FROM l WHERE category <> 'idle' UNION ALL SELECT l.channel, start, run, code, total, intent, k.category FROM l JOIN k USING (channel) WHERE l.category = 'idle') SELECT channel, category, intent, concat('run', run, ':', code) AS source_label, start, round(total, 5) AS total FROM r")
def a14_labelled_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events and samples to epochs of two channels, with labels that name their run, split by category; idle epochs go to each."""
    of = spark.createDataFrame(_CODES, "parity int, code string, intent string, category string")
    s = signal(spark, sf).where(F.col("channel").isin("view", "click"))
    cues = s.where("x > 150").select("channel", F.col("i").alias("start"), F.floor(F.col("i") / 100).alias("run"), F.concat(F.lit("T"), F.col("event_id") % 3).alias("code"))
    cut = joins.cut_epochs(s, cues, ["channel"], 24, 2).withColumn("parity", (F.col("run") % 2).cast("int")).join(F.broadcast(of), ["parity", "code"])
    # Three categories at most for each channel.
    cats = cut.where("category != 'idle'").groupBy("channel").agg(F.collect_set("category").alias("cats"))
    target = F.when(F.col("category") == "idle", F.col("cats")).otherwise(F.array("category"))
    total = F.round(F.aggregate("signal", F.lit(0.0), lambda a, x: a + x), 5)
    label = F.concat(F.lit("run"), F.col("run").cast("string"), F.lit(":"), F.col("code"))
    return cut.join(cats, "channel", "left").select("channel", F.explode(target).alias("category"), "intent", label.alias("source_label"), "start", total.alias("total"))


@query("WITH new AS (SELECT o_custkey, max(o_orderdate) AS updated, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS threshold FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1), old AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS threshold, TIMESTAMP '1995-01-01' AS updated FROM customer), p AS (SELECT c_custkey, c_nationkey, coalesce(new.threshold, old.threshold) AS threshold, coalesce(new.updated, old.updated) AS updated FROM old LEFT JOIN new ON o_custkey = c_custkey) SELECT *, threshold IS NOT NULL AS calibrated, row_number() OVER (PARTITION BY c_nationkey ORDER BY updated DESC, c_custkey) AS recency FROM p")
def a18_profile_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Stored profiles overlaid with newer values where those are not null, with the place by recency in each nation."""
    since = F.lit("1995-01-01").cast("timestamp_ntz")
    new = table(spark, sf, "orders").where(F.col("o_orderdate") >= since).groupBy("o_custkey")
    new = new.agg(F.max("o_orderdate").alias("at"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 4).alias("value"))
    old = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("threshold"))
    p = old.join(new, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_nationkey", F.coalesce("value", "threshold").alias("threshold"), F.coalesce("at", since).alias("updated"))
    back = p.withColumn("_back", -F.unix_micros(F.col("updated").cast("timestamp")))  # a nation may hold any share of the profiles
    placed = information.running_count(back, ["c_nationkey"], ["_back", "c_custkey"], F.lit(1), "recency").drop("_back")
    return placed.withColumn("calibrated", F.col("threshold").isNotNull())


_MONTAGES = "m(name, n_channels, labels) AS (VALUES " + ", ".join(f"('{m[0]}', {m[1]}, '{'|'.join(m[2])}')" for m in dims.MONTAGES) + ")"
_NAMES = "['" + "', '".join(m[0] for m in dims.MONTAGES) + "']"


@query(f"WITH {_MONTAGES}, r AS (SELECT vec_id, {_NAMES}[CAST(vec_id % 5 + 1 AS INT)] AS montage, {_NAMES}[CAST(vec_id // 5 % 5 + 1 AS INT)] AS wanted, vec_id % 7 = 0 AS taken FROM embeddings) SELECT vec_id, CASE WHEN n_channels = 8 AND NOT taken THEN wanted ELSE montage END AS montage, CASE WHEN n_channels = 8 AND NOT taken THEN labels END AS labels, CASE WHEN n_channels <> 8 THEN 'channel count' WHEN taken THEN 'exists' END AS refused FROM r JOIN m ON m.name = wanted")
def a20_relabel(spark: SparkSession, sf: str) -> DataFrame:
    """Another montage for recordings: metadata alone changes; refused where the channel count differs or a result exists."""
    names = F.array(*[F.lit(m[0]) for m in dims.MONTAGES])
    at = lambda k: F.element_at(names, (k % 5 + 1).cast("int"))
    v = F.col("vec_id")
    r = table(spark, sf, "embeddings").select("vec_id", at(v).alias("montage"), at(F.floor(v / 5)).alias("wanted"), (v % 7 == 0).alias("taken"), F.lit(8).alias("channels"))
    m = dims.montages(spark).select(F.col("montage").alias("wanted"), "n_channels", F.array_join("labels", "|").alias("labels"))
    refused = F.when(F.col("n_channels") != F.col("channels"), "channel count").when(F.col("taken"), "exists")
    out = r.join(F.broadcast(m), "wanted").withColumn("refused", refused)
    return out.select("vec_id", F.when(F.col("refused").isNull(), F.col("wanted")).otherwise(F.col("montage")).alias("montage"), F.when(F.col("refused").isNull(), F.col("labels")).alias("labels"), "refused")


@query(f"WITH {_LABELS} SELECT category, intent, count(*) AS n FROM lab WHERE user_id % 3 = 2 GROUP BY 1, 2")
def a24_partitioned_tables(spark: SparkSession, sf: str) -> DataFrame:
    """One table with partitions by scope (user, shared, public) and category in place of folders; the public ones are read."""
    scope = F.element_at(F.array(F.lit("user"), F.lit("shared"), F.lit("public")), (F.col("user_id") % 3 + 1).cast("int"))
    path = scratch_path(spark, "layout")
    _labelled(spark, sf).withColumn("scope", scope).write.partitionBy("scope", "category").parquet(path)
    return spark.read.parquet(path).where("scope = 'public'").groupBy("category", "intent").agg(F.count(F.lit(1)).alias("n"))


@query("WITH own AS (SELECT o_custkey, max(o_orderkey) AS model FROM orders WHERE o_totalprice > 300000 GROUP BY 1) SELECT c_custkey, model, CASE WHEN model IS NULL THEN 'starter' ELSE 'personal' END AS source, CASE WHEN model IS NULL THEN 8.0 END AS low, CASE WHEN model IS NULL THEN 30.0 END AS high, CASE WHEN model IS NULL THEN 1e-6 ELSE 1.0 END AS scale, CASE WHEN model IS NULL THEN 'volts' ELSE 'uV' END AS units FROM customer LEFT JOIN own ON o_custkey = c_custkey")
def b22_serving_contract(spark: SparkSession, sf: str) -> DataFrame:
    """What a model wants done before it: a bare starter one band-pass and volts, a personal one nothing."""
    own = table(spark, sf, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.max("o_orderkey").alias("model"))
    m = table(spark, sf, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    bare = F.col("model").isNull()
    contract = {"source": F.when(bare, "starter").otherwise("personal"), "low": F.when(bare, 8.0), "high": F.when(bare, 30.0), "scale": F.when(bare, 1e-6).otherwise(1.0), "units": F.when(bare, "volts").otherwise("uV")}
    return m.select("c_custkey", "model", *[c.alias(n) for n, c in contract.items()])


@query(f"WITH {_MONTAGES}, p AS (SELECT vec_id, vec_id % 5 AS session, {_NAMES}[CAST(vec_id % 5 + 1 AS INT)] AS name, CASE WHEN vec_id % 3 = 0 THEN 160 ELSE 250 END AS fs, len(embedding) // 8 AS n_times FROM embeddings), q AS (SELECT session, fs, p.n_times, upper(labels) = (SELECT upper(labels) FROM m WHERE name = 'cyton8_mi') AS same FROM p JOIN m USING (name)) SELECT session, fs, count(*) AS recordings, concat_ws(',', CASE WHEN NOT bool_and(same) THEN 'channels' END, CASE WHEN fs <> 250 THEN 'rate' END, CASE WHEN max(n_times) <> 8 OR min(n_times) <> 8 THEN 'length' END) AS mismatches FROM q GROUP BY 1, 2")
def b26_transfer_check(spark: SparkSession, sf: str) -> DataFrame:
    """What keeps a pretrained model (cyton8_mi, 250 Hz, 8 samples) from recordings: channel order, rate or epoch length."""
    names = F.array(*[F.lit(m[0]) for m in dims.MONTAGES])
    upper = lambda labels: F.transform(labels, lambda x: F.upper(x))
    wanted = F.array(*[F.lit(x.upper()) for m in dims.MONTAGES if m[0] == "cyton8_mi" for x in m[2]])
    p = epochs(spark, sf).select("session", F.element_at(names, (F.col("session") + 1).cast("int")).alias("montage"), F.when(F.col("epoch_id") % 3 == 0, 160).otherwise(250).alias("fs"), F.size(F.col("signal")[0]).alias("n_times"))
    q = p.join(F.broadcast(dims.montages(spark)), "montage").withColumn("same", upper(F.col("labels")) == wanted)
    length = (F.max("n_times") != 8) | (F.min("n_times") != 8)
    reasons = F.concat_ws(",", F.when(~F.bool_and("same"), "channels"), F.when(F.col("fs") != 250, "rate"), F.when(length, "length"))
    return q.groupBy("session", "fs").agg(F.count(F.lit(1)).alias("recordings"), reasons.alias("mismatches"))


@query("WITH c AS (SELECT l_suppkey, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS k, CAST(count_if(l_returnflag <> 'N') AS BIGINT) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, k, n, CASE WHEN k = 0 THEN 1.0 ELSE (SELECT round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))), 6) FROM range(k, n + 1) t(i)) END AS p FROM c")
def d15_binomial_test(spark: SparkSession, sf: str) -> DataFrame:
    """Chance of as many hits or more by coin flips."""
    flag = F.col("l_returnflag")
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(flag == "R").alias("k"), F.count_if(flag != "N").alias("n"))
    return c.select("l_suppkey", "k", "n", F.round(stats.binomial_upper(F.col("k"), F.col("n")), 6).alias("p"))


@query(f"WITH {EPOCHS}, p AS (SELECT epoch_id, label, ch, ln(var_pop(x) + 1e-12) AS p FROM epochs WHERE ch IN (2, 4) AND label IN (0, 1) GROUP BY 1, 2, 3), a AS (SELECT avg(p) FILTER (ch = 4 AND label = 0) AS l4, avg(p) FILTER (ch = 4 AND label = 1) AS r4, avg(p) FILTER (ch = 2 AND label = 0) AS l3, avg(p) FILTER (ch = 2 AND label = 1) AS r3 FROM p) SELECT round(l4, 6) AS left_c4, round(r4, 6) AS right_c4, round(l3, 6) AS left_c3, round(r3, 6) AS right_c3, CASE WHEN l4 < r4 AND r3 < l3 THEN 'PASS' ELSE 'WARN' END AS verdict FROM a")
def d16_lateralisation(spark: SparkSession, sf: str) -> DataFrame:
    """Whether power falls on the side opposite to the imagined hand (0 left, 1 right) at the montage's lateral pair."""
    p = long_epochs(spark, sf).where(F.col("ch").isin(2, 4) & F.col("label").isin(0, 1)).groupBy("epoch_id", "label", "ch").agg(C.log_variance(F.var_pop("x")).alias("p"))
    of = lambda ch, y: F.avg(F.when((F.col("ch") == ch) & (F.col("label") == y), F.col("p")))
    a = p.agg(of(4, 0).alias("left_c4"), of(4, 1).alias("right_c4"), of(2, 0).alias("left_c3"), of(2, 1).alias("right_c3"))
    verdict = F.when((F.col("left_c4") < F.col("right_c4")) & (F.col("right_c3") < F.col("left_c3")), "PASS").otherwise("WARN")
    return rounded(a.withColumn("verdict", verdict), "left_c4", "right_c4", "left_c3", "right_c3")


@query()
def d17_mains(spark: SparkSession, sf: str) -> DataFrame:
    """Power at 48 to 52 Hz over that at 8 to 30 Hz in windows of the stream; above 2 the mains are in the way."""
    power = lambda low, high: signals.band_powers(F.col("signal"), 250.0, (low, high))
    w = stream_windows(spark, sf).select("epoch_id", F.posexplode(F.arrays_zip(power(48.0, 52.0).alias("hum"), power(8.0, 30.0).alias("brain"))).alias("ch", "z"))
    ratio = F.col("z.hum") / F.greatest("z.brain", F.lit(1e-12))
    return w.select("epoch_id", "ch", ratio.alias("ratio"), F.when(ratio > 2, "mains").otherwise("ok").alias("tier"))


@query()
def d40_readiness_levels(spark: SparkSession, sf: str) -> DataFrame:
    """READY, or what keeps a subject's recordings from it: the first of nothing kept, over a third dropped, no C3/Cz/C4, few of a class.

    missing: labels of the task set (0 to 9 and 10 for idle) that the recordings lack.
    """
    c = _screened(spark, sf).groupBy("subject", "label").agg(F.count_if("keep").alias("kept"), F.count(F.lit(1)).alias("trials"))
    t = c.groupBy("subject").agg(F.min("kept").alias("least"), F.sum("kept").alias("kept"), F.sum("trials").alias("trials"), F.collect_set(F.col("label").cast("int")).alias("seen"))
    names = F.array(*[F.lit(m[0]) for m in dims.MONTAGES])
    m = dims.montages(spark).select("montage", F.forall(F.array(*map(F.lit, ("C3", "CZ", "C4"))), lambda x: F.array_contains("labels", x)).alias("core"))
    t = t.withColumn("montage", F.element_at(names, (F.col("subject") % 5 + 1).cast("int"))).join(F.broadcast(m), "montage")
    verdict = F.when(F.col("kept") == 0, "NOT_READY: nothing kept").when(1 - F.col("kept") / F.col("trials") > quality.MOST_DROPPED, "NOT_READY: too many dropped").when(~F.col("core"), "LIMITED: no C3/Cz/C4").when(F.col("least") < 8, "INCOMPLETE: too few of a class").otherwise("READY")
    return t.select("subject", "montage", "kept", "trials", verdict.alias("readiness"), F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(10)), "seen")).alias("missing"))


@query(f"WITH {EPOCHS}, a AS (SELECT subject, epoch_id, ch, stddev_pop(x) > 0.04 AS alive FROM epochs GROUP BY 1, 2, 3), e AS (SELECT subject, epoch_id, count_if(alive) AS alive FROM a GROUP BY 1, 2) SELECT subject, epoch_id, alive, alive = 8 AS ready FROM e", longs="alive")
def d41_startup_check(spark: SparkSession, sf: str) -> DataFrame:
    """A start needs all eight channels alive."""
    a = long_epochs(spark, sf).groupBy("subject", "epoch_id", "ch").agg((F.stddev_pop("x") > _LIMITS["flat"]).alias("alive"))
    return a.groupBy("subject", "epoch_id").agg(F.count_if("alive").alias("alive")).withColumn("ready", F.col("alive") == 8)


@query("WITH RECURSIVE n AS (SELECT p_size AS n, count(*) AS parts FROM part GROUP BY 1), d(n, k, low, size, depth) AS (SELECT n, CAST(k AS INT), 0, n, 0 FROM n, range(0, n) t(k) UNION ALL SELECT n, k, CASE WHEN k < low + (size + 1) // 2 THEN low ELSE low + (size + 1) // 2 END, CASE WHEN k < low + (size + 1) // 2 THEN (size + 1) // 2 ELSE size // 2 END, depth + 1 FROM d WHERE size > 1) SELECT n, parts, round(avg(depth), 6) AS mean_depth, max(depth) AS deepest FROM d JOIN n USING (n) WHERE size = 1 GROUP BY 1, 2")
def d45_candidate_depths(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions needed for each candidate of a tree that is halved with the larger half on the left: mean and most."""
    n = table(spark, sf, "part").groupBy(F.col("p_size").alias("n")).agg(F.count(F.lit(1)).alias("parts"))
    k = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def halve(state, _):
        half = F.floor((state["size"] + 1) / 2).cast("int")
        left = F.col("k") < state["low"] + half
        split = F.struct(F.when(left, state["low"]).otherwise(state["low"] + half).alias("low"), F.when(left, half).otherwise(state["size"] - half).alias("size"), (state["depth"] + 1).alias("depth"))
        return F.when(state["size"] > 1, split).otherwise(state)

    start = F.struct(F.lit(0).alias("low"), F.col("n").cast("int").alias("size"), F.lit(0).alias("depth"))
    depth = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2("n")).cast("int") + 1), start, halve)["depth"]
    return k.withColumn("d", depth).groupBy("n", "parts").agg(F.round(F.avg("d"), 6).alias("mean_depth"), F.max("d").alias("deepest"))


@query(f"WITH {DECISIONS}, s AS (SELECT *, t_ms - min(t_ms) OVER (PARTITION BY session) AS since FROM decisions), b AS (SELECT session, CASE WHEN since < 600000000 THEN 0 WHEN since < 1200000000 THEN 10 ELSE 20 END AS minute, is_artifact, command, predicted IN ('signup', 'purchase') AS target FROM s) SELECT session, minute, count(*) AS windows, count_if(is_artifact) AS artifacts, count_if(is_artifact AND command IS NULL) AS caught, round(count_if(target AND command IS NOT NULL) / nullif(count_if(target), 0), 6) AS accuracy FROM b GROUP BY 1, 2", longs="artifacts caught")
def d46_fatigue(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and caught artifacts by the time since a session's start; a minute stands for the million seconds of these tables."""
    since = F.col("t_ms") - F.min("t_ms").over(Window.partitionBy("session"))
    minute = F.when(since < 600_000_000, 0).when(since < 1_200_000_000, 10).otherwise(20)
    target, fired = F.col("predicted").isin("signup", "purchase"), F.col("command").isNotNull()
    b = decisions(spark, sf).withColumn("minute", minute).groupBy("session", "minute")
    return b.agg(F.count(F.lit(1)).alias("windows"), F.count_if("is_artifact").alias("artifacts"), F.count_if(F.col("is_artifact") & ~fired).alias("caught"), F.round(F.count_if(target & fired) / F.nullif(F.count_if(target), F.lit(0)), 6).alias("accuracy"))


_GROUPS = "g AS (SELECT vec_id // 250 AS subject, (vec_id // 10) * (vec_id // 10) % 13 AS grp, count(*) AS n FROM embeddings GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, grp) AS k FROM g), f AS (SELECT subject, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS grp, CAST(NULL AS INT) AS fold, CAST([0, 0, 0] AS BIGINT[]) AS loads FROM g GROUP BY 1 UNION ALL SELECT subject, k, grp, fold, list_transform(loads, lambda x, i: x + CASE WHEN i = fold + 1 THEN n ELSE 0 END) FROM (SELECT o.subject, o.k, o.grp, o.n, f.loads, CAST(list_position(f.loads, list_min(f.loads)) - 1 AS INT) AS fold FROM f JOIN o ON o.subject = f.subject AND o.k = f.k + 1))"


def _balanced(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = epochs(spark, sf).select("epoch_id", F.floor(F.col("epoch_id") / 250).alias("subject"), (F.floor(F.col("epoch_id") / 10) * F.floor(F.col("epoch_id") / 10) % 13).alias("grp"), "label", "signal")
    return e, learning.balanced_folds(e, ["subject"], "grp", 3)


@query(f"WITH RECURSIVE {_GROUPS}, e AS (SELECT f.subject, f.fold, embeddings.label FROM embeddings JOIN f ON f.subject = vec_id // 250 AND f.grp = (vec_id // 10) * (vec_id // 10) % 13), c AS (SELECT subject, fold, label, count(*) AS n FROM e GROUP BY 1, 2, 3), a AS (SELECT subject, label, sum(n) AS n_all FROM c GROUP BY 1, 2), w AS (SELECT subject, count(*) AS classes FROM a GROUP BY 1) SELECT c.subject, c.fold, sum(c.n) AS trials, count(*) = any_value(classes) AND bool_and(n_all > n) AS complete FROM c JOIN a ON a.subject = c.subject AND a.label = c.label JOIN w ON w.subject = c.subject GROUP BY 1, 2", longs="trials")
def k3_group_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Whole groups dealt to three folds a subject, the largest first, each to the lightest fold; complete where both sides have all classes."""
    e, folds = _balanced(spark, sf)
    return learning.complete_folds(e.drop("signal").join(folds, ["subject", "grp"]), ["subject"], "fold", "label")


@query()
def k9_public_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """A category's model on a pool of two datasets, judged on people held out by greedy folds; such a model is never served."""
    pool = joins.union_tagged({n: epochs(spark, sf).where(F.col("subject") % 2 == k).select("epoch_id", F.col("subject").cast("string").alias("person"), "label", "signal") for k, n in enumerate(("first", "second"))}, ["person"])
    pool = pool.withColumns({"all": F.lit(1), "y": F.col("label") % 2})
    folds = learning.balanced_folds(pool, ["all"], "person", 5)
    found = learning.held_out_csp_lda(pool.join(F.broadcast(folds.drop("all")), "person"), "fold", 5, "y").where("predicted is not null")
    report = stats.class_report(stats.confusion(found.select("source", "y", "predicted"), "y", "predicted"), "y", "predicted")
    return report.agg(F.avg("recall").alias("balanced_accuracy"), F.sum("support").alias("trials")).crossJoin(folds.agg(F.count(F.lit(1)).alias("people"))).withColumn("runtime_ready", F.lit(False))  # one row each


@query()
def k12_k13_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    """Per person five stages in one gated table: raw signal, filter, separability, classifier (beyond chance), runtime.

    The stages are the layers of a diagnosis: channel tiers and screening; the filtered signal's definiteness; the best
    channel's F; the binomial test of held-out hits; the share of trials that a threshold on the margin would fire.
    """
    person = F.floor(F.col("epoch_id") / 250).alias("subject")
    alive = long_epochs(spark, sf).groupBy("epoch_id", "ch").agg(F.stddev_pop("x").alias("sd")).groupBy(person).agg((F.count_if(F.col("sd") > _LIMITS["flat"]) / F.count(F.lit(1)) >= 1 - quality.MOST_DROPPED).alias("raw"))
    kept = epochs(spark, sf).select("epoch_id", signals.bandpassed(F.col("signal"), 250.0, 8.0, 30.0).alias("y")).select(person, F.forall("y", lambda c: F.array_max(c) > F.array_min(c)).alias("live")).groupBy("subject").agg((F.avg(F.col("live").cast("int")) >= 0.9).alias("filter"))
    p = long_epochs(spark, sf).withColumns({"y": F.col("label") % 2, "subject": person}).groupBy("epoch_id", "subject", "y", "ch").agg(C.log_variance(F.var_pop("x")).alias("p"))
    apart = stats.anova(p, ["subject", "ch"], "p", "y").groupBy("subject").agg((F.max("f") > 1).alias("separability"))
    cv = learning.cross_validate(_folds(spark, sf), "subject", "fold", "y", ["csp_lda"]).groupBy("subject").agg(F.sum("correct").alias("k"), F.sum("n").alias("n"))
    cv = cv.select("subject", (stats.binomial_upper(F.col("k"), F.col("n")) < 0.05).alias("classifier"), (F.col("k") / F.col("n") >= 0.7).alias("runtime"))
    rows = alive.join(kept, "subject").join(apart, "subject").join(cv, "subject", "left")
    names = ("raw", "filter", "separability", "classifier", "runtime")
    stages = F.array(*[F.struct(F.lit(i + 1).alias("stage"), F.lit(n).alias("name"), F.when(F.coalesce(F.col(n), F.lit(False)), "PASS").otherwise("FAIL").alias("status")) for i, n in enumerate(names)])
    out = quality.gates(rows.select("subject", F.explode(stages).alias("s")).select("subject", "s.*"), ["subject"], "stage", "status")
    return out.select("subject", "stage", "name", "gated", "first_fail")


@query()
def k1_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """A calibration as rows: the sweep's best percentile by information rate, written as profiles of all subjects and read again."""
    best = d11_d12_threshold_sweep(spark, sf).agg(F.max_by("percentile", F.struct("itr", -F.col("fp_idle"))).alias("percentile"), F.max_by("threshold", F.struct("itr", -F.col("fp_idle"))).alias("threshold"))
    d = decisions(spark, sf).withColumns({"subject": F.col("session") % 10, "active": F.col("predicted").isin("signup", "purchase")})
    apart = stats.separation(d, ["subject"], "score", "active").select("subject", "mean_on", "mean_off", "d")
    held = d.groupBy("subject").agg(F.count(F.lit(1)).alias("windows"), F.count_if("is_artifact").alias("artifacts"), F.max("t_ms").alias("updated"))
    path = scratch_path(spark, "profiles")
    apart.join(held, "subject").crossJoin(F.broadcast(best)).write.parquet(path)  # one row of the sweep
    return spark.read.parquet(path)
