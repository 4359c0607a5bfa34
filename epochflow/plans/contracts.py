"""What sets of labels promise and how it is kept: sides, advice, codes, strict look-ups, consent and export, reports, callbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochflow.functions import dims
from epochflow.functions import kernels as K
from epochflow.operators import intents, quality, signals, spatial, windows
from epochflow.plans.analysis import _MACHINE
from epochflow.plans.base import DECISIONS, EPOCHS, decisions, epochs, query, table
from epochflow.plans.live import _events
from epochflow.plans.relational import _ORDER
from epochflow.plans.streams import _BLOCKS
from epochflow.sources import sharing
from epochflow.sources.scratch import scratch_path, staged
from epochflow.streaming import jobs


@query(f"WITH {_BLOCKS} SELECT session, CASE predicted WHEN 'view' THEN 'idle' WHEN 'error' THEN 'artifact' WHEN 'click' THEN 'other' ELSE 'kept' END AS side, CASE predicted WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE -1 END AS code, count(*) AS n, count(DISTINCT block) AS blocks FROM b GROUP BY 1, 2, 3")
def b3_label_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Trials that training takes, and the idle and artifact sets beside them; blocks are those of the whole recording."""
    b = windows.block_ids(decisions(spark, sf), ["session"], "n", "predicted")
    b = b.select("session", "block", *intents.label_side(F.col("predicted"), ["signup", "purchase"], ["view"], ["error"]))
    return b.groupBy("session", "side", "code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block").alias("blocks"))


# Eight events make a set of one to eight labels; sets differ in size.
_SET, _PART, _ORD = "event_id // 8", "event_id % 8 <= event_id // 8 % 8", "(7 * event_id + 3 * (event_id // 8) + event_id // 64) % 13"
_IT = f"it(intent, category, ord) AS (VALUES {_ORDER})"


def _sets(spark: SparkSession, sf: str, idle: bool) -> DataFrame:
    e = F.col("event_id")
    g = F.floor(e / 8)
    at = F.pmod(7 * e + 3 * g + F.floor(e / 64), F.lit(13))
    rows = table(spark, sf, "events").where(e % 8 <= g % 8).select(g.alias("set_id"), (F.when(e % 5 == 0, 23).otherwise(at) if idle else at).alias("canonical_order"))
    return rows.join(dims.intents(spark), "canonical_order").withColumnRenamed("canonical_order", "ord")


@query(
    f"WITH {_IT}, s AS (SELECT DISTINCT {_SET} AS set_id, it.* FROM events JOIN it ON it.ord = {_ORD} WHERE {_PART}), a AS (SELECT a.set_id, string_agg(a.intent || '/' || b.intent, ',' ORDER BY a.ord) AS adjacent FROM s a JOIN s b ON a.set_id = b.set_id AND b.ord = a.ord + 1 AND a.ord <> 4 AND a.category = 'finger' AND b.category = 'finger' GROUP BY 1), "
    "n AS (SELECT set_id, count(*) AS n, count_if(category = 'finger') AS fingers, count_if(category = 'finger' AND ord < 5) AS l, count_if(category = 'finger' AND ord >= 5) AS r FROM s GROUP BY 1) "
    "SELECT set_id, n, fingers, CASE WHEN n = 1 THEN 'BASIC' WHEN n = 2 THEN 'PILOT' WHEN n = 3 THEN 'EXPERIMENTAL' WHEN n <= 5 THEN 'ADVANCED' ELSE 'RESEARCH_ONLY' END AS level, coalesce(adjacent, '') AS adjacent, "
    "concat_ws('; ', CASE WHEN n = 1 THEN 'one intent needs idle trials to tell it from no action' END, CASE WHEN adjacent IS NOT NULL THEN 'neighbouring fingers of one hand look alike' END, CASE WHEN fingers >= 4 THEN 'four finger classes or more are an advanced task' END, "
    "CASE WHEN fingers >= 6 THEN 'six finger classes or more are for research only' END, CASE WHEN l >= 3 THEN 'three classes or more use the left hand' END, CASE WHEN r >= 3 THEN 'three classes or more use the right hand' END) AS warnings FROM n LEFT JOIN a USING (set_id)",
    longs="fingers",
)
def b13_intent_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """How hard a set of intents is, which fingers are neighbours, and what to warn of."""
    a = intents.assess(_sets(spark, sf, idle=False), "set_id")
    return a.select("set_id", F.col("n").cast("bigint").alias("n"), F.col("fingers").cast("bigint").alias("fingers"), "level", F.array_join("adjacent", ",").alias("adjacent"), F.array_join("warnings", "; ").alias("warnings"))


@query(f"WITH {_IT}, s AS (SELECT DISTINCT {_SET} AS set_id, intent, ord FROM events JOIN it ON it.ord = CASE WHEN event_id % 5 = 0 THEN 23 ELSE {_ORD} END WHERE {_PART}) SELECT set_id, intent, CAST(row_number() OVER (PARTITION BY set_id ORDER BY ord) - 1 AS INT) AS code, count(*) OVER (PARTITION BY set_id) >= 2 AS trainable FROM s")
def b20_canonical_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of a set's classes in canonical order, idle last; a set of one class needs idle trials first."""
    return intents.class_codes(_sets(spark, sf, idle=True), "set_id")


@query("WITH t AS (SELECT o_custkey, count(*) >= 10 AS trained FROM orders GROUP BY 1), c AS (SELECT c_custkey, ['trca', 'fbcca', 'auto'][c_custkey % 3 + 1] AS prefer, coalesce(trained, false) AS trained FROM customer LEFT JOIN t ON c_custkey = o_custkey), p AS (SELECT *, CASE WHEN prefer <> 'auto' THEN prefer WHEN trained THEN 'trca' ELSE 'fbcca' END AS classifier FROM c) SELECT c_custkey, classifier, classifier = 'fbcca' OR trained AS ready FROM p")
def b24_preferred_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """The classifier that a person prefers, or the trained one where they leave it open; trca without a model is not ready."""
    trained = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count(F.lit(1)) >= 10).alias("trained"))
    prefer = F.element_at(F.array(*map(F.lit, ("trca", "fbcca", "auto"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey").join(trained, "c_custkey", "left").select("c_custkey", *intents.classifier(prefer, F.col("trained")))


# Strict look-ups

_CODES = {"signup": ("left_hand", "both_hands"), "purchase": ("right_hand", "both_feet"), "view": ("idle", "idle"), "click": ("left_foot", "right_foot"), "error": ("idle", "idle")}
#: (dataset, run, code, label): runs 2 and 3 are of another task; dataset 1 does not say what `error` means, nor what a click of run 3.
_MAPPED = [(d, r, c, pair[r // 2]) for d in range(3) for r in range(4) for c, pair in _CODES.items() if d != 1 or (c != "error" and (c, r) != ("click", 3))]
_MAP = "m(dataset, run, code, label) AS (VALUES " + ", ".join(f"({d}, {r}, '{c}', '{x}')" for d, r, c, x in _MAPPED) + "), e AS (SELECT user_id % 3 AS dataset, event_id % 4 AS run, event_type AS code FROM events)"


def _coded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events").select((F.col("user_id") % 3).alias("dataset"), (F.col("event_id") % 4).alias("run"), F.col("event_type").alias("code"))
    return e, spark.createDataFrame(_MAPPED, "dataset bigint, run bigint, code string, label string")


@query(f"WITH {_MAP} SELECT dataset, run, code, count(*) AS n FROM e ANTI JOIN m USING (dataset, run, code) GROUP BY 1, 2, 3")
def c3_unknown_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of a dataset's runs that its mapping lacks."""
    return intents.unknown(*_coded(spark, sf), ["dataset", "run", "code"])


@query(f"WITH {_MAP} SELECT dataset, label, count(*) AS n FROM e JOIN m USING (dataset, run, code) WHERE dataset <> 1 GROUP BY 1, 2")
def c3_strict_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the two datasets whose mapping is whole; a code without one would stop the query."""
    e, m = _coded(spark, sf)
    return intents.resolved(e.where("dataset <> 1"), m, ["dataset", "run", "code"]).groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT ['index', 'name', 'intent'][event_id % 3 + 1] AS by, event_type AS target, count(*) AS n FROM events GROUP BY 1, 2")
def c13_strict_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Commands that ask for a target by its place, its name or its intent; one that no target answers would stop the query."""
    targets = [(k, c, i) for k, (c, i) in enumerate(zip(_CODES, ("left_hand", "right_hand", "both_feet", "left_pinky", "idle")))]
    t = spark.createDataFrame(targets, "idx int, name string, intent string")
    by = F.element_at(F.array(*map(F.lit, ("index", "name", "intent"))), (F.col("event_id") % 3 + 1).cast("int"))
    place = F.element_at(F.create_map(*[F.lit(x) for k, c, i in targets for x in (c, f"{k}|{c}|{i}")]), F.col("event_type"))
    asked = table(spark, sf, "events").select(by.alias("by"), F.element_at(F.split(place, r"\|"), (F.col("event_id") % 3 + 1).cast("int")).alias("key"))
    return intents.resolved(asked, intents.target_keys(t), ["by", "key"]).groupBy("by", "target").agg(F.count(F.lit(1)).alias("n"))


# Consent and export

@query(
    "WITH a AS (SELECT o_custkey AS u, o_orderdate AS day, CASE o_orderpriority WHEN '1-URGENT' THEN 'enable' WHEN '2-HIGH' THEN 'sync' WHEN '5-LOW' THEN 'disable' END AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders), c AS (SELECT u, max(p) FILTER (a = 'enable') AS en, max(p) FILTER (a = 'disable') AS dis, max(p) FILTER (a = 'sync') AS sy, max_by(day, p) FILTER (a = 'sync') AS sync_at FROM a GROUP BY 1), "
    "t AS (SELECT vec_id // 3 + 1 AS u, count(*) AS trials FROM embeddings GROUP BY 1), s AS (SELECT c_custkey, en IS NOT NULL AND (dis IS NULL OR en > dis) AS enabled, CASE WHEN sy > en THEN sync_at END + INTERVAL 400 DAY AS after, trials FROM customer LEFT JOIN c ON u = c_custkey LEFT JOIN t ON t.u = c_custkey), "
    "d AS (SELECT *, CASE WHEN NOT enabled THEN 'not_enabled' WHEN after > TIMESTAMP '1998-08-02' THEN 'not_due' WHEN trials > 0 THEN 'exported' ELSE 'no_data' END AS status FROM s) SELECT c_custkey, status, CASE WHEN status = 'not_due' THEN CAST(CAST(after AS DATE) AS VARCHAR) END AS next, CASE WHEN status = 'exported' THEN trials ELSE 0 END AS trials, CASE WHEN status = 'exported' THEN 'not_due' WHEN status = 'no_data' THEN 'no_data' ELSE status END AS again FROM d"
)
def a17_k15_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Consent from its log, who is due, and their tangent vectors exported; asked again at once, nobody exported is due."""
    names = {"1-URGENT": sharing.ENABLE, "2-HIGH": sharing.SYNC, "5-LOW": sharing.DISABLE}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("o_orderpriority"))
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", kind.alias("action"))
    agreed = staged(sharing.consent(log, "c_custkey", "o_orderdate", "o_orderkey", "action", days=400), "consent")
    users, now = table(spark, sf, "customer").select("c_custkey"), F.lit("1998-08-02").cast("timestamp_ntz")
    c = epochs(spark, sf).select((F.floor(F.col("epoch_id") / 3) + 1).alias("c_custkey"), "label", signals.covariance(F.col("signal")).alias("cov"))
    small = spatial.tangent_features(c, spatial.frechet_mean(c)).select("c_custkey", F.col("label").cast("tinyint").alias("class"), F.transform("features", lambda x: x.cast("float")).alias("features"))
    path = scratch_path(spark, "shared")
    first = staged(sharing.sync(small, sharing.status(users, agreed, "c_custkey", now), "c_custkey", f"{path}/1"), "synced")
    later = sharing.sync(small, sharing.status(users, sharing.after_sync(agreed, first, "c_custkey", now), "c_custkey", now), "c_custkey", f"{path}/2")
    return first.join(later.select("c_custkey", F.col("status").alias("again")), "c_custkey").select("c_custkey", "status", F.col("next").cast("date").cast("string").alias("next"), "trials", "again")


# Reports and callbacks

@query(
    f"WITH {DECISIONS}, c AS (SELECT session, count(*) AS n, CAST(count_if(score > 150) AS BIGINT) AS loud, CAST(count_if(is_artifact) AS BIGINT) AS art, count(command) AS cmd FROM decisions GROUP BY 1), s AS (SELECT session, n, unnest([1, 2, 3]) AS k, unnest(['signal', 'artifacts', 'commands']) AS name, unnest([loud, art, cmd]) AS flagged, unnest([CASE WHEN loud > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN art * 3 > n THEN 'FAIL' WHEN art * 5 > n THEN 'WARN' ELSE 'PASS' END, CASE WHEN cmd = 0 THEN 'FAIL' ELSE 'PASS' END]) AS status FROM c), "
    "f AS (SELECT session, min(k) AS k FROM s WHERE status = 'FAIL' GROUP BY 1) SELECT s.session, CAST(to_json({'session': s.session, 'first_failure': max(name) FILTER (s.k = f.k), 'stages': list({'name': name, 'status': CASE WHEN s.k > f.k THEN 'SKIP' ELSE status END, 'details': {'windows': n, 'flagged': flagged}} ORDER BY s.k)}) AS VARCHAR) AS report FROM s LEFT JOIN f USING (session) GROUP BY 1"
)
def a23_stage_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A machine-readable report a session: its stages with numbers, what follows a failure skipped, and the first failure."""
    c = decisions(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 150).alias("loud"), F.count_if("is_artifact").alias("art"), F.count("command").alias("cmd"))
    n = F.col("n")
    stages = {"signal": ("loud", F.when(F.col("loud") > 0, "FAIL").otherwise("PASS")), "artifacts": ("art", F.when(F.col("art") * 3 > n, "FAIL").when(F.col("art") * 5 > n, "WARN").otherwise("PASS")), "commands": ("cmd", F.when(F.col("cmd") == 0, "FAIL").otherwise("PASS"))}
    rows = [F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), status.alias("status"), F.struct(n.alias("windows"), F.col(flagged).alias("flagged")).alias("details")) for k, (name, (flagged, status)) in enumerate(stages.items())]
    return quality.json_reports(c.select("session", F.explode(F.array(*rows)).alias("s")).select("session", "s.*"), ["session"], "k", "name", "status", "details")


@query(f"{_MACHINE} SELECT m.session, d.t_ms, d.command FROM m JOIN decisions d USING (session, n) WHERE m.state = 'DISPATCHED'")
def j4_dispatch_callbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Commands as a callback on the live stream gets them; it keeps each batch under its number, so a repeated one counts once."""
    path = scratch_path(spark, "callbacks")
    out = jobs.decide(_events(spark, sf), run=2, lockout=60_000_000, refractory=90_000_000)
    jobs.on_dispatch(out, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}"), f"{path}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows").select("session", "t_ms", "command")


_DENSITY = "(re * re + im * im) / (40.0 * 3)"


@query(
    f"WITH {EPOCHS}, h AS (SELECT epoch_id, ch, s, (x - avg(x) OVER (PARTITION BY epoch_id, ch)) * (0.5 - 0.5 * cos(2 * pi() * s / 8)) AS x FROM epochs), b AS (SELECT epoch_id, ch, k, sum(x * cos(2 * pi() * ((k * s) % 8) / 8)) AS re, sum(x * sin(2 * pi() * ((k * s) % 8) / 8)) AS im FROM h, range(1, 5) t(k) GROUP BY 1, 2, 3), "
    f"p AS (SELECT epoch_id, ch, max(CASE WHEN k = 1 THEN 2 * {_DENSITY} END) AS p1, max(CASE WHEN k = 2 THEN 2 * {_DENSITY} END) AS p2, max(CASE WHEN k = 3 THEN 2 * {_DENSITY} END) AS p3, max(CASE WHEN k = 4 THEN {_DENSITY} END) AS p4 FROM b GROUP BY 1, 2) "
    "SELECT epoch_id, ch, unnest(['beta', 'broad']) AS band, round(unnest([2.5 * (p3 + p4), 2.5 * (p1 + 2 * p2 + 2 * p3 + p4)]), 6) AS power FROM p"
)
def h22_band_integrals(spark: SparkSession, sf: str) -> DataFrame:
    """Power of each channel integrated over the named bands that hold two bins or more of these short epochs (read at 40 Hz)."""
    e = epochs(spark, sf).select("epoch_id", F.posexplode(signals.band_integrals(F.col("signal"), 40.0, K.BANDS)).alias("ch", "bands"))
    return e.select("epoch_id", "ch", F.explode("bands").alias("band", "power")).withColumn("power", F.round("power", 6))
