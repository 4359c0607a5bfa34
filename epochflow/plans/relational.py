"""Labels, filters, set operations, dimension joins and table upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochflow.functions import columns as C
from epochflow.functions import dims
from epochflow.operators import joins
from epochflow.plans.base import DECISIONS, decisions, epochs, query, rounded, table

#: The five event types stand for labels of a session.
_INTENT_OF = {"signup": "left-hand", "purchase": "Right Hand", "view": "feet", "click": "left little finger", "error": "rest"}


def _values(pairs: dict) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())


_KNOWN = {**{i: i for some in dims.INTENTS.values() for i in some}, **dims.ALIASES}
_ORDER = ", ".join(f"('{i}', '{c}', {k})" for k, (i, c) in enumerate((i, c) for c, some in dims.INTENTS.items() for i in some))
_LABELS = f"raw(event_type, name) AS (VALUES {_values(_INTENT_OF)}), al(alias, intent) AS (VALUES {_values(_KNOWN)}), it(intent, category, ord) AS (VALUES {_ORDER}), lab AS (SELECT e.event_id, e.user_id, it.* FROM events e JOIN raw USING (event_type) JOIN al ON al.alias = regexp_replace(lower(trim(name)), '[\\s-]+', '_', 'g') JOIN it USING (intent))"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a free-text intent name, resolved by alias to intent, category and order."""
    raw = F.create_map(*[F.lit(x) for kv in _INTENT_OF.items() for x in kv])
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", C.intent_key(raw[F.col("event_type")]).alias("alias"))
    known = e.join(F.broadcast(dims.aliases(spark)), "alias")
    return known.join(F.broadcast(dims.intents(spark)), "intent").withColumnRenamed("canonical_order", "ord")


@query(f"WITH {_LABELS} SELECT intent, category, count(*) AS n FROM lab GROUP BY 1, 2")
def b8_b9_c3_intents(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).groupBy("intent", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LABELS}, s AS (SELECT DISTINCT user_id % 7 AS subject, category FROM lab WHERE category <> 'idle') SELECT subject, CASE WHEN count(*) = 1 THEN min(category) END AS category, count(*) AS categories FROM s GROUP BY 1")
def b9_single_category(spark: SparkSession, sf: str) -> DataFrame:
    s = _labelled(spark, sf).where("category != 'idle'").select((F.col("user_id") % 7).alias("subject"), "category").distinct()
    return s.groupBy("subject").agg(F.when(F.count(F.lit(1)) == 1, F.min("category")).alias("category"), F.count(F.lit(1)).alias("categories"))


@query("SELECT p_partkey, concat('button::', lpad(CAST(p_size AS VARCHAR), 3, '0'), '::', p_name) AS label, p_size AS idx, p_name AS name FROM part")
def b10_button_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", C.button_label(F.col("p_size"), F.col("p_name")).alias("label"))
    idx, name = C.button_parts(F.col("label"))
    return rows.select("p_partkey", "label", idx.alias("idx"), name.alias("name"))


@query("SELECT c_mktsegment, count_if(starts_with(c_name, 'Customer#0000')) AS n FROM customer GROUP BY 1", longs="n")
def b4_label_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count_if(F.startswith("c_name", F.lit("Customer#0000"))).alias("n"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1")
def b3_b5_label_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("event_type").isin("signup", "purchase", "error")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, round(value * 1000000.0, 6) AS microvolts FROM events")
def b6_unit_scaling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "events").select("event_id", (F.col("value") * 1e6).alias("microvolts")), "microvolts")


@query("WITH m AS (SELECT o_custkey, string_agg(concat('a', o_orderkey, '=', o_orderpriority), ',' ORDER BY o_orderkey) AS m, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n AS actions, regexp_extract(m, '^(a[0-9]+)=', 1) AS first_action FROM m")
def b11_intent_map(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.struct("o_orderkey", F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("="), F.col("o_orderpriority")).alias("p"))
    text = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(pair)).alias("ps"))
    m = text.select("o_custkey", C.intent_map(F.array_join(F.transform("ps", lambda p: p["p"]), ",")).alias("m"))
    return m.select("o_custkey", F.size("m").cast("bigint").alias("actions"), F.map_keys("m")[0].alias("first_action"))


@query(f"WITH {_LABELS}, s AS (SELECT DISTINCT user_id, intent, ord FROM lab WHERE intent <> 'idle'), k AS (SELECT user_id, string_agg(intent, '|' ORDER BY ord) AS joined, string_agg(intent, '-' ORDER BY ord) AS short, count(*) AS n FROM s GROUP BY 1) SELECT user_id, concat(CASE WHEN n <= 3 THEN short ELSE concat(n, '-intents') END, '-', substr(sha1(joined), 1, 8)) AS task_set FROM k")
def b12_f1_task_set_key(spark: SparkSession, sf: str) -> DataFrame:
    s = _labelled(spark, sf).where("intent != 'idle'").groupBy("user_id").agg(F.array_sort(F.collect_set(F.struct("ord", "intent"))).alias("s"))
    return s.select("user_id", C.task_set_key(F.transform("s", lambda x: x["intent"])).alias("task_set"))


@query(f"WITH {_LABELS}, s AS (SELECT DISTINCT user_id, intent, ord, category FROM lab WHERE intent <> 'idle'), n AS (SELECT user_id, count(*) AS n, count_if(category = 'finger') AS fingers FROM s GROUP BY 1) SELECT user_id, n, CASE WHEN n = 1 THEN 'BASIC' WHEN n = 2 THEN 'PILOT' WHEN n = 3 THEN 'EXPERIMENTAL' WHEN n <= 5 THEN 'ADVANCED' ELSE 'RESEARCH_ONLY' END AS level, (SELECT count(*) FROM s a JOIN s b ON a.user_id = b.user_id AND a.category = 'finger' AND b.category = 'finger' AND b.ord = a.ord + 1 AND a.ord <> 4 WHERE a.user_id = n.user_id) AS adjacent FROM n")
def b13_assess_intents(spark: SparkSession, sf: str) -> DataFrame:
    s = _labelled(spark, sf).where("intent != 'idle'").select("user_id", "intent", "ord", "category").distinct()
    follows = (F.lag("ord").over(Window.partitionBy("user_id").orderBy("ord")) == F.col("ord") - 1) & (F.col("category") == "finger") & (F.col("ord") != len(dims.FINGERS))
    n = F.col("n")
    level = F.when(n == 1, "BASIC").when(n == 2, "PILOT").when(n == 3, "EXPERIMENTAL").when(n <= 5, "ADVANCED").otherwise("RESEARCH_ONLY")
    return s.withColumn("_a", follows).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("_a").alias("adjacent")).withColumn("level", level)


@query("WITH m(montage, n_channels, top) AS (VALUES " + ", ".join(f"('{m[0]}', {m[1]}, {max(m[3] + m[4])})" for m in dims.MONTAGES) + ") SELECT montage, count(*) AS trials, bool_and(top + 1 <= n_channels) AS valid FROM m JOIN (SELECT vec_id, ['" + "', '".join(m[0] for m in dims.MONTAGES) + "'][CAST(vec_id % 5 + 1 AS INT)] AS montage FROM embeddings) USING (montage) GROUP BY 1")
def b14_a20_montages(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(m[0]) for m in dims.MONTAGES])
    e = epochs(spark, sf).select(F.element_at(names, (F.col("session") + 1).cast("int")).alias("montage"))
    valid = F.array_max(F.concat("ssvep", "artifact")) + 1 <= F.col("n_channels")
    return e.join(F.broadcast(dims.montages(spark)), "montage").groupBy("montage").agg(F.count(F.lit(1)).alias("trials"), F.bool_and(valid).alias("valid"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 2 WHEN value < 10.0 THEN -1 WHEN event_type = 'signup' THEN 0 WHEN event_type = 'purchase' THEN 1 ELSE 3 END AS code FROM events")
def b15_b28_gate_and_code(spark: SparkSession, sf: str) -> DataFrame:
    """Class index, 2 for a blink, -1 below the gate; a command that the classes lack has a code of its own, 3."""
    command = F.when(F.col("event_type") == "error", F.lit("BLINK")).otherwise(C.gate(F.col("event_type"), F.col("value"), 10.0))
    return table(spark, sf, "events").select("event_id", F.coalesce(C.code(command, ["signup", "purchase"]), F.lit(3)).alias("code"))


@query("SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS command FROM events")
def b16_suppress_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    mapped = F.array(F.lit("signup"), F.lit("purchase"))
    return table(spark, sf, "events").select("event_id", F.when(F.array_contains(mapped, F.col("event_type")), F.col("event_type")).alias("command"))


@query("SELECT c_custkey, datediff('day', CAST(max(o_orderdate) AS DATE), DATE '1999-01-01') AS age, max(o_orderdate) IS NULL OR datediff('day', CAST(max(o_orderdate) AS DATE), DATE '1999-01-01') > 365 AS stale FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def b17_h16_staleness(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    last = c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.max("o_orderdate").alias("last"))
    age = F.datediff(F.lit("1999-01-01").cast("date"), F.col("last").cast("date"))
    return last.select("c_custkey", age.cast("bigint").alias("age"), F.coalesce(age > 365, F.lit(True)).alias("stale"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS subject, regexp_extract(url, '/([a-z]{2})/', 1) AS session, regexp_extract(url, '/([0-9]+)', 1) AS run FROM pages")
def b18_path_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf, "pages").select("page_id", part("^[a-z]+://([^/]+)").alias("subject"), part("/([a-z]{2})/").alias("session"), part("/([0-9]+)").alias("run"))


@query("WITH p AS (SELECT p_partkey, 5 + p_size / 2.0 AS f FROM part), q AS (SELECT *, greatest(2, CAST(floor(60 / f + 0.5) AS INT)) AS period FROM p) SELECT p_partkey, period, round(60.0 / period, 6) AS rendered, round(abs(60.0 / period - f) / f * 100, 6) AS error_pct, count(*) OVER (PARTITION BY period) > 1 AS collides FROM q")
def b19_flicker_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "part").select("p_partkey", (5 + F.col("p_size") / 2.0).alias("f")).withColumn("period", C.refresh_period(F.col("f"), 60.0))
    made = 60.0 / F.col("period")
    counts = f.groupBy("period").agg((F.count(F.lit(1)) > 1).alias("collides"))
    return rounded(f.select("p_partkey", "period", made.alias("rendered"), (F.abs(made - F.col("f")) / F.col("f") * 100).alias("error_pct")).join(F.broadcast(counts), "period"), "rendered", "error_pct")


@query("SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code, n FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def b20_class_encoding(spark: SparkSession, sf: str) -> DataFrame:
    n = epochs(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("bigint").alias("code"), "n")  # one row a class


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'BLINK' WHEN o_totalprice > 200000 THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN 'mi' END AS command FROM orders")
def b22_b23_hybrid_priority(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", C.hybrid(F.col("o_orderstatus") == "F", F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 2 == 0, F.lit("mi"))).alias("command"))


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) >= 10 THEN 'trca' ELSE 'fbcca' END AS classifier FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def b24_classifier_choice(spark: SparkSession, sf: str) -> DataFrame:
    trained = table(spark, sf, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) >= 10).alias("trained"))
    c = table(spark, sf, "customer")
    return c.join(trained, c["c_custkey"] == trained["o_custkey"], "left").select("c_custkey", F.when(F.coalesce("trained", F.lit(False)), "trca").otherwise("fbcca").alias("classifier"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE k = 25 % n")
def b25_trial_lookup(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    r = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return r.where("k = 25 % n").select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, count(*) AS blocks, sum(CAST(1 + (l_quantity * 250 - 750) // 250 AS BIGINT)) AS windows, round(sum(l_quantity) / 60, 6) AS minutes FROM lineitem WHERE l_quantity >= 3 GROUP BY 1", longs="windows")
def b27_protocol_plan(spark: SparkSession, sf: str) -> DataFrame:
    plan = table(spark, sf, "lineitem").where("l_quantity >= 3")
    made = 1 + F.floor((F.col("l_quantity") * 250 - 750) / 250)
    return plan.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("blocks"), F.sum(made).alias("windows"), F.round(F.sum("l_quantity") / 60, 6).alias("minutes"))


@query("SELECT n_nationkey, n_name, count(*) AS n FROM nation JOIN customer ON upper(trim(n_name)) = upper(concat(' ', trim(n_name), ' ')[2:-2]) AND n_nationkey = c_nationkey GROUP BY 1, 2")
def c4_common_names(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumn("key", F.upper(F.trim("n_name")))
    c = table(spark, sf, "customer").join(F.broadcast(n.select("n_nationkey", F.concat(F.lit(" "), "n_name").alias("raw"))), F.col("c_nationkey") == F.col("n_nationkey")).select(F.upper(F.trim("raw")).alias("key"))
    return c.join(F.broadcast(n), "key").groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, fold, p.name AS pipeline, count(*) AS n FROM (SELECT label, vec_id % 3 AS fold FROM embeddings), (VALUES ('csp_lda'), ('riemann_lr')) p(name) GROUP BY 1, 2, 3")
def c8_cross_jobs(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.createDataFrame([("csp_lda",), ("riemann_lr",)], "pipeline string")
    rows = epochs(spark, sf).groupBy("label", (F.col("epoch_id") % 3).alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    return rows.crossJoin(F.broadcast(p))  # two pipelines


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey")
def c10_g4_missing(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 250000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("WITH f AS (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 2) SELECT o_custkey, count(*) AS n FROM orders SEMI JOIN f USING (o_custkey) GROUP BY 1")
def c11_division(spark: SparkSession, sf: str) -> DataFrame:
    return joins.having_all(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["F", "O"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT o_custkey AS key, 1 AS rank, max(o_orderkey) AS model FROM orders WHERE o_totalprice > 300000 GROUP BY 1 UNION ALL SELECT o_custkey, 2, min(o_orderkey) FROM orders GROUP BY 1) SELECT key, min(rank) AS rank, min_by(model, rank) AS model FROM c GROUP BY 1")
def c12_a4_model_resolution(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    exact = o.where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("key")).agg(F.lit(1).alias("rank"), F.max("o_orderkey").alias("model"))
    other = o.groupBy(F.col("o_custkey").alias("key")).agg(F.lit(2).alias("rank"), F.min("o_orderkey").alias("model"))
    return joins.prefer(exact.unionByName(other), ["key"], "rank").select("key", "rank", "model")


@query(f"WITH {DECISIONS}, t(name, idx) AS (VALUES ('signup', 0), ('purchase', 1), ('view', 2)) SELECT session, n, idx FROM decisions LEFT JOIN t ON command = name WHERE command IS NOT NULL")
def c13_command_targets(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.createDataFrame([("signup", 0), ("purchase", 1), ("view", 2)], "command string, idx int")
    return decisions(spark, sf).where("command is not null").join(F.broadcast(t), "command", "left").select("session", "n", "idx")


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def e7_rank_one(spark: SparkSession, sf: str) -> DataFrame:
    return joins.first_per(table(spark, sf, "customer"), ["c_nationkey"], F.col("c_acctbal").desc(), "c_custkey").select("c_nationkey", "c_custkey")


@query("WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS lo, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) AS hi FROM supplier) SELECT s_nationkey, s_suppkey FROM r WHERE lo <= 2 OR hi <= 2")
def f2_both_ends(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return joins.both_ends(rows, ["s_nationkey"], ["s_acctbal", "s_suppkey"], 2).select("s_nationkey", "s_suppkey")


@query("SELECT DISTINCT 60.0 / p_size AS hz FROM part WHERE p_size >= 2 AND 60 % p_size = 0 ORDER BY 1 DESC LIMIT 4")
def f4_top_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_size >= 2 and 60 % p_size = 0").select((60.0 / F.col("p_size")).alias("hz")).distinct().orderBy(F.col("hz").desc()).limit(4)


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (back <= 3) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) GROUP BY 1")
def f6_last_lines(spark: SparkSession, sf: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    rows = table(spark, sf, "conversations").withColumn("back", back).where("back <= 3")
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("tail"))


@query("SELECT id, source, nation FROM (SELECT concat('customer:', c_custkey) AS id, 'customer' AS source, c_nationkey AS nation FROM customer UNION ALL SELECT concat('supplier:', s_suppkey), 'supplier', s_nationkey FROM supplier)")
def g1_g2_union(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return joins.union_tagged({"customer": c, "supplier": s}, ["id"])


@query("SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def g3_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query(f"WITH {_LABELS}, cats AS (SELECT DISTINCT user_id, category FROM lab WHERE category <> 'idle'), r AS (SELECT user_id, event_id, category FROM lab WHERE category <> 'idle' UNION ALL SELECT l.user_id, l.event_id, c.category FROM lab l JOIN cats c USING (user_id) WHERE l.category = 'idle') SELECT user_id, category, count(*) AS n FROM r GROUP BY 1, 2")
def g5_a14_route_categories(spark: SparkSession, sf: str) -> DataFrame:
    lab = _labelled(spark, sf)
    cats = lab.where("category != 'idle'").groupBy("user_id").agg(F.collect_set("category").alias("cats"))
    target = F.when(F.col("category") == "idle", F.col("cats")).otherwise(F.array("category"))
    return lab.join(cats, "user_id", "left").select("user_id", F.explode(target).alias("category")).groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, trim(regexp_replace(lower(trim(concat(' ', c_name, ' (', c_mktsegment, ')!'))), '[^a-z0-9_.-]+', '_', 'g'), '._-') AS slug FROM customer")
def h1_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", C.slug(F.concat(F.lit(" "), "c_name", F.lit(" ("), "c_mktsegment", F.lit(")!"))).alias("slug"))


@query(f"WITH {_LABELS} SELECT event_id, concat(upper(intent[1]), replace(intent, '_', ' ')[2:]) AS shown FROM lab")
def h2_display_name(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("event_id", C.display_name(F.concat(F.lit(dims.INTENT_PREFIX), "intent")).alias("shown"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract(props, '$.k') || '}' AS out FROM events")
def h15_json(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("out"))


@query("SELECT o_custkey, o_orderkey AS latest FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def a2_latest_recording(spark: SparkSession, sf: str) -> DataFrame:
    """Of recordings of one date the one with the largest key."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", F.col("r.o_orderkey").alias("latest"))


@query("SELECT label, trial, count(*) AS samples FROM (SELECT vec_id // 10 AS trial, label, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2")
def a5_unpack_trials(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("trial"), "label", F.explode("embedding"))
    return e.groupBy("label", "trial").agg(F.count(F.lit(1)).alias("samples"))


@query("SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS clicked, coalesce(nullif(l_returnflag, 'N') = 'R', false) AS complied FROM lineitem")
def a8_b21_cue_log(spark: SparkSession, sf: str) -> DataFrame:
    clicked = F.nullif(F.col("l_returnflag"), F.lit("N"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clicked.alias("clicked"), F.coalesce(clicked == "R", F.lit(False)).alias("complied"))


@query(f"WITH {DECISIONS} SELECT session, max(n) AS windows, max_by(predicted, n) AS last_command, max(t_ms) AS updated FROM decisions GROUP BY 1")
def a11_status_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf).groupBy("session").agg(F.max("n").alias("windows"), F.max_by("predicted", "n").alias("last_command"), F.max("t_ms").alias("updated"))


@query("SELECT vec_id, len(embedding) = 64 AS shape_ok, len(list_filter(embedding, lambda x: isfinite(x))) = 64 AS finite_ok, label IS NOT NULL AS label_ok FROM embeddings")
def a12_a13_archive_rules(spark: SparkSession, sf: str) -> DataFrame:
    from epochflow.sources.archives import epoch_rules

    return epoch_rules(table(spark, sf, "embeddings"), "embedding", 64, "label").select("vec_id", "shape_ok", "finite_ok", "label_ok")


@query("SELECT c_custkey, count(o_orderkey) = 0 OR max(o_orderdate) + INTERVAL 30 DAY <= TIMESTAMP '1998-06-01' AS due FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def a17_sync_due(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    last = c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.max("o_orderdate").alias("last"))
    return last.select("c_custkey", F.coalesce(F.col("last") + F.make_dt_interval(F.lit(30)) <= F.lit("1998-06-01").cast("timestamp_ntz"), F.lit(True)).alias("due"))


@query("SELECT c_custkey, c_name AS subject, count(o_orderkey) > 0 AS calibrated, max(o_orderdate) AS updated FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def a18_profiles(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey", F.col("c_name").alias("subject")).agg((F.count("o_orderkey") > 0).alias("calibrated"), F.max("o_orderdate").alias("updated"))


@query("SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 'public' ELSE 'shared' END AS scope, regexp_extract(url, '/([a-z]{2})/', 1) AS category FROM pages")
def a24_table_layout(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.when(F.startswith("url", F.lit("https:")), "public").otherwise("shared").alias("scope"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("category"))


@query("SELECT count(DISTINCT o_orderstatus) <= 1 AS o_orderstatus, count(DISTINCT o_orderpriority) <= 1 AS o_orderpriority FROM orders")
def d38_b26_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return joins.stated_once(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
