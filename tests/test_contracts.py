"""Strict look-ups, sets of intents, consent and export, reports."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochflow.functions import kernels as K
from epochflow.operators import intents, quality, signals
from epochflow.sources import sharing


def test_unknown_doubled_and_null_keys_stop_a_strict_look_up(spark):
    m = spark.createDataFrame([(1, "a", "left"), (1, "b", "right"), (2, "a", "left")], "run int, code string, label string")
    rows = lambda *r: spark.createDataFrame(list(r), "id int, run int, code string")
    fine = rows((1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (4, 1, "a"))
    assert sorted((r["id"], r["label"]) for r in intents.resolved(fine, m, ["run", "code"]).collect()) == [(1, "left"), (2, "right"), (3, "left"), (4, "left")]
    for bad in ((5, 2, "b"), (5, None, "a")):
        with pytest.raises(Exception, match="unknown"):
            # Counting needs no label; the check holds all the same.
            intents.resolved(rows((1, 1, "a"), bad), m, ["run", "code"]).count()
    with pytest.raises(Exception, match="more than once"):
        intents.resolved(fine, m.union(m.where("code = 'b'")), ["run", "code"]).count()
    assert intents.resolved(rows(), m, ["run", "code"]).count() == 0
    assert [tuple(r) for r in intents.unknown(rows((1, 1, "a"), (2, 2, "b"), (3, 2, "b")), m, ["run", "code"]).collect()] == [(2, "b", 2)]


def test_targets_answer_to_place_name_and_intent(spark):
    t = spark.createDataFrame([(0, "lamp", "left_hand"), (1, "door", None)], "idx int, name string, intent string")
    asked = spark.createDataFrame([("index", "1"), ("name", "lamp"), ("intent", "left_hand")], "by string, key string")
    got = intents.resolved(asked, intents.target_keys(t), ["by", "key"]).collect()
    assert {(r["by"], r["target"]) for r in got} == {("index", "door"), ("name", "lamp"), ("intent", "lamp")}
    with pytest.raises(Exception, match="unknown"):
        intents.resolved(spark.createDataFrame([("name", "left_hand")], "by string, key string"), intents.target_keys(t), ["by", "key"]).collect()


def _rows(spark, sets):
    from epochflow.functions import dims

    place = {i: (c, k) for k, (i, c) in enumerate((i, c) for c, some in dims.INTENTS.items() for i in some)}
    return spark.createDataFrame([(k, i, *place[i]) for k, some in sets.items() for i in some], "k string, intent string, category string, ord int")


def test_advice_on_sets(spark):
    sets = {
        "one": ["left_hand", "idle", "left_hand"],
        "thumb and pinky": ["left_pinky", "right_thumb"],  # next to each other in the list, not on a hand
        "pair": ["left_index", "left_middle", "both_feet"],
        "hand": ["right_thumb", "right_index", "right_middle", "right_ring", "right_pinky"],
        "both": ["left_thumb", "left_middle", "left_pinky", "right_thumb", "right_middle", "right_pinky"],
        "nothing": ["idle"],
    }
    got = {r["k"]: r for r in intents.assess(_rows(spark, sets), "k").collect()}
    assert set(got) == set(sets) - {"nothing"}
    assert [(got[k]["n"], got[k]["fingers"], got[k]["level"]) for k in ("one", "thumb and pinky", "pair", "hand", "both")] == [(1, 0, "BASIC"), (2, 2, "PILOT"), (3, 2, "EXPERIMENTAL"), (5, 5, "ADVANCED"), (6, 6, "RESEARCH_ONLY")]
    assert got["thumb and pinky"]["adjacent"] == [] and got["thumb and pinky"]["warnings"] == []
    assert got["pair"]["adjacent"] == ["left_index/left_middle"] and len(got["pair"]["warnings"]) == 1
    assert got["hand"]["adjacent"] == ["right_thumb/right_index", "right_index/right_middle", "right_middle/right_ring", "right_ring/right_pinky"]
    assert [w.split(" ")[0] for w in got["hand"]["warnings"]] == ["neighbouring", "four", "three"] and got["hand"]["warnings"][-1].endswith("right hand")
    assert [w.split(" ")[0] for w in got["both"]["warnings"]] == ["four", "six", "three", "three"]
    assert got["one"]["warnings"] == ["one intent needs idle trials to tell it from no action"]


def test_codes_put_idle_last(spark):
    got = intents.class_codes(_rows(spark, {"a": ["idle", "right_hand", "left_thumb", "right_hand"], "b": ["left_hand"], "c": ["left_hand", "idle"]}), "k").collect()
    assert sorted((r["k"], r["code"], r["intent"], r["trainable"]) for r in got) == [("a", 0, "left_thumb", True), ("a", 1, "right_hand", True), ("a", 2, "idle", True), ("b", 0, "left_hand", False), ("c", 0, "left_hand", True), ("c", 1, "idle", True)]


def test_consent_due_exports_and_a_repeated_try(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    log = [
        ("new", day(1), 1, "enable"),
        ("gone", day(1), 1, "enable"), ("gone", day(2), 2, "disable"),
        ("back", day(1), 1, "enable"), ("back", day(2), 2, "sync"), ("back", day(3), 3, "disable"), ("back", day(4), 4, "enable"),  # a new grant forgets the export
        ("fresh", day(1), 1, "enable"), ("fresh", day(20), 2, "sync"),
        ("edge", day(1), 1, "enable"), ("edge", day(18), 2, "sync"),  # due on the day itself
        ("empty", day(1), 1, "enable"),
        ("tie", day(1), 2, "enable"), ("tie", day(1), 1, "disable"),  # of one moment, by number
        ("never", day(1), 1, "sync"), ("never", day(2), 2, None),
    ]
    agreed = sharing.consent(spark.createDataFrame(log, "u string, at timestamp_ntz, k int, a string"), "u", "at", "k", "a")
    users = spark.createDataFrame([(u,) for u in ("new", "gone", "back", "fresh", "edge", "empty", "tie", "never", "stranger")], "u string")
    features = spark.createDataFrame([(u, [float(i)]) for u in ("new", "gone", "back", "fresh", "edge", "tie", "never") for i in range(2)], "u string, f array<double>")
    now = F.lit("2024-01-26").cast("timestamp_ntz")  # day 25
    stated = sharing.status(users, agreed, "u", now)
    result = sharing.sync(features, stated, "u", f"file://{tmp_path}/out")
    want = {"new": "exported", "gone": "not_enabled", "back": "exported", "fresh": "not_due", "edge": "exported", "empty": "no_data", "tie": "exported", "never": "not_enabled", "stranger": "not_enabled"}
    assert {r["u"]: r["status"] for r in result.collect()} == want
    assert {r["u"]: r["next"] for r in result.collect() if r["next"]} == {"fresh": day(27)}
    files = lambda: sorted((r["u"], r["f"][0]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    first = files()
    assert {u for u, _ in first} == {"new", "back", "edge", "tie"} and len(first) == 8
    assert {r["u"]: r["status"] for r in sharing.sync(features, stated, "u", f"file://{tmp_path}/out").collect()} == want and files() == first
    later = sharing.status(users, sharing.after_sync(agreed, result, "u", now), "u", now)
    assert {r["u"]: r["status"] for r in later.collect()} == {u: {"exported": "not_due", "no_data": "due"}.get(s, s) for u, s in want.items()}


def test_reports_name_the_first_failure(spark):
    rows = [("a", 1, "link", "PASS", 3), ("a", 2, "signal", "FAIL", None), ("a", 3, "model", "PASS", 1), ("b", 2, "signal", "WARN", 2), ("b", 1, "link", "PASS", 0)]
    df = spark.createDataFrame(rows, "s string, k int, name string, status string, n int").withColumn("details", F.struct("n"))
    got = {r["s"]: json.loads(r["report"]) for r in quality.json_reports(df, ["s"], "k", "name", "status", "details").collect()}
    assert got["a"] == {"s": "a", "first_failure": "signal", "stages": [{"name": "link", "status": "PASS", "details": {"n": 3}}, {"name": "signal", "status": "FAIL", "details": {"n": None}}, {"name": "model", "status": "SKIP", "details": {"n": 1}}]}
    assert got["b"]["first_failure"] is None and [x["name"] for x in got["b"]["stages"]] == ["link", "signal"]


def test_integrated_power_is_that_of_a_sine(spark):
    t = np.arange(1000) / 250
    x = np.stack([3 * np.sin(2 * np.pi * 10 * t), 2 * np.sin(2 * np.pi * 20 * t)])
    row = spark.createDataFrame([(x.tolist(),)], "signal array<array<double>>").select(signals.band_integrals(F.col("signal"), 250.0, K.BANDS).alias("b")).first()["b"]
    # All of it lies in the broad band; the named bands cut off what the window leaks past their edges.
    assert row[0]["broad"] == pytest.approx(4.5, rel=0.01) and row[1]["broad"] == pytest.approx(2.0, rel=0.01)
    assert row[0]["beta"] < 0.05 and row[1]["alpha"] < 0.05 and set(row[0]) == set(K.BANDS)
    f, p = K.welch(x, 250.0)
    inside = (f >= 8) & (f < 13)
    steps = (p[0, inside][1:] + p[0, inside][:-1]) / 2 * np.diff(f[inside])
    assert row[0]["alpha"] == pytest.approx(steps.sum())
