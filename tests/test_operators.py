import io
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochflow.operators import decide, learning, spatial, stats, windows
from epochflow.operators.signals import covariance
from epochflow.sources import archives


def test_state_table():
    d = decide.Decider()
    steps = [(0, "a", False), (1, "a", False), (2, "a", False), (3, "a", False), (4, "a", False), (5, "a", False), (1202, "a", False), (1203, None, False), (1204, "b", True), (1205, "b", False), (2003, "b", False), (2004, "b", False), (2005, "b", False), (2006, "b", False), (2403, "b", False)]
    want = ["BUILDING", "BUILDING", "DISPATCHED", "BUILDING", "BUILDING", "REFRACTORY", "DISPATCHED", "REJECTED", "BLINK", "LOCKOUT", "LOCKOUT", "BUILDING", "BUILDING", "REFRACTORY", "DISPATCHED"]
    assert [d.step(*s) for s in steps] == want


def test_tree_and_scan():
    t = decide.Tree(5)
    assert [t.decide(x) for x in (True, False, False, False)] == [None, 2, None, 4]
    t.decide(True)
    t.undo()
    assert (t.low, t.size) == (0, 5)
    s = decide.Scan(3)
    assert [s.decide(x) for x in (True, False, False, True, True, False)] == [None, 1, 1, None, None, 0]


def test_text_log():
    log = decide.TextLog()
    got = [log.accept(v) for v in ["h", "I", decide.SPACE, decide.SPACE, "x", decide.BACKSPACE, decide.UNDO, ". ", "a", decide.CLEAR, decide.UNDO, decide.SPEAK, None]]
    assert got == ["H", "Hi", "Hi ", "Hi ", "Hi x", "Hi ", "Hi x", "Hi x. ", "Hi x. A", "", "Hi x. A", "Hi x. A", "Hi x. A"]


def test_fold_survives_batches_and_equals_a_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(int(s), n, int(n * 300), [None, "a", "b"][int(rng.integers(0, 3))] if n % 5 else "a", bool(rng.random() < 0.1)) for s in range(4) for n in range(200)]
    df = spark.createDataFrame(rows, "session long, n long, t_ms long, command string, is_artifact boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {(r.session, r.n): r.state for r in decide.decide(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state = {}
    for s, n, t, c, a in rows:
        assert got[s, n] == state.setdefault(s, decide.Decider()).step(t, c, a)


def test_hop_windows_forms_agree(spark):
    df = spark.createDataFrame([(k, i, float(i * (k + 1))) for k in range(2) for i in range(101)], "c long, i long, x double")
    fast = windows.hop_windows(df, ["c"], "i", "x", 30, 10).orderBy("c", "k").collect()
    slow = windows.hop_windows_exploded(df, ["c"], "i", "x", 30, 10).orderBy("c", "k").collect()
    assert fast == slow and len(fast) == 16 and fast[0].signal[10:] == fast[1].signal[:20]
    whole = windows.stitch(windows.hop_windows(df, ["c"], "i", "x", 30, 10), ["c"], 10).orderBy("c", "i").collect()
    assert [(r.c, r.i, r.x) for r in whole] == [(k, i, float(i * (k + 1))) for k in range(2) for i in range(100)]
    assert windows.hop_windows(df, ["c"], "i", "x", 30, 7).count() == 22
    gap = df.where("i != 35")
    assert windows.hop_windows(gap, ["c"], "i", "x", 30, 10).count() == windows.hop_windows_exploded(gap, ["c"], "i", "x", 30, 10).count() == 10


def _trials(n=60, seed=4):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = rng.standard_normal((n, 8, 64))
    x[y == 0, 2] *= 0.35
    x[y == 1, 4] *= 0.35
    return x, y


def test_models_beat_chance_and_groups_stay_whole(spark):
    x, y = _trials()
    rows = [(1, int(i // 12), int(y[i]), x[i].tolist()) for i in range(len(y))]
    df = spark.createDataFrame(rows, "subject long, fold int, y long, signal array<array<double>>")
    cv = learning.cross_validate(df, "subject", "fold", "y", ["csp_lda", "riemann_lr", "riemann_lda"])
    got = {r.pipeline: r.acc for r in cv.groupBy("pipeline").agg({"accuracy": "avg"}).withColumnRenamed("avg(accuracy)", "acc").collect()}
    assert min(got.values()) > 0.85 and len(got) == 3
    assert cv.count() == 15


def test_frechet_mean_properties(spark):
    x, _ = _trials(12)
    one = spark.createDataFrame([(x[0].tolist(),)] * 3, "signal array<array<double>>").select(covariance("signal").alias("cov"))
    c = np.array(one.first().cov).reshape(8, 8)
    assert np.allclose(spatial.frechet_mean(one), c, atol=1e-8)
    many = spark.createDataFrame([(t.tolist(),) for t in x], "signal array<array<double>>").select(covariance("signal").alias("cov"))
    mean = spatial.frechet_mean(many, rounds=30)
    a = np.eye(8) + 0.1 * np.arange(64).reshape(8, 8) / 64
    turned = spark.createDataFrame([((a @ np.array(r.cov).reshape(8, 8) @ a.T).ravel().tolist(),) for r in many.collect()], "cov array<double>")
    assert np.allclose(spatial.frechet_mean(turned, rounds=30), a @ mean @ a.T, atol=1e-6)


def test_f_tail():
    assert stats.beta_upper(4.0, 1, 10) == pytest.approx(0.0734, abs=2e-4)
    assert stats.beta_upper(1.0, 5, 5) == pytest.approx(0.5, abs=1e-9)
    assert stats.beta_upper(0.0, 2, 3) == 1.0


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.6), (1, 0.8), (1, 0.7)], "p long, s double")
    a, b = (stats.bootstrap_interval(df, ["p"], "s", 400).first() for _ in range(2))
    assert a == b and 0.5 <= a.low < 0.65 < a.high <= 0.8


def test_archives_are_checked_written_and_read(spark, tmp_path):
    row = ("e1", "s", "r", "left", 250.0, "cyton8_mi", "mV", [[1.0, 2.0], [3.0, 4.0]])
    good = spark.createDataFrame([row], archives.EPOCH_SCHEMA)
    archives.write_archive(good, f"file://{tmp_path}/a")
    got = archives.read_archive(spark, f"file://{tmp_path}/a").first()
    assert got.signal == [[1000.0, 2000.0], [3000.0, 4000.0]] and got.units == "uV"
    bad = spark.createDataFrame([row, (*row[:3], None, -1.0, *row[5:7], [[1.0], [float("nan"), 2.0]])], archives.EPOCH_SCHEMA)
    assert {r.rule for r in archives.check_archive(bad).collect()} == {"label is missing", "fs is not positive", "channels differ in length", "signal is not finite"}
    with pytest.raises(ValueError, match="label is missing"):
        archives.write_archive(bad, f"file://{tmp_path}/b")


def test_npz_and_csv_readers(spark, tmp_path):
    buffer = io.BytesIO()
    np.savez(buffer, X=np.ones((2, 3, 4), np.float32), labels=np.array(["a", "b"]), fs=250, montage="cyton8_mi", subject="p1")
    (tmp_path / "r1.npz").write_bytes(buffer.getvalue())
    got = archives.read_npz(spark, f"file://{tmp_path}/*.npz").orderBy("epoch_id").collect()
    assert [(r.epoch_id, r.label, r.subject, r.fs) for r in got] == [("r1:0", "a", "p1", 250.0), ("r1:1", "b", "p1", 250.0)]
    lines = ["Time;C3;cz"] + [f"{i * 4};{i};{-i}" for i in range(50)] + ["x;1;2"]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    rows = archives.read_continuous_csv(spark, f"file://{tmp_path}/s.csv", "time", ["c3", "CZ"], ";", 2.0).orderBy("i", "channel").collect()
    assert len(rows) == 100 and rows[0].fs == pytest.approx(250.0) and rows[3].x == 2.0


@pytest.mark.parametrize(("separator", "step", "fs"), [(",", 0.002, 500.0), ("\t", 4.0, 250.0), (";", 0.04, 25.0)])
def test_csv_is_sniffed_and_numbered_by_ranges(spark, tmp_path, separator, step, fs):
    rng = np.random.default_rng(3)
    order = rng.permutation(300)
    lines = [separator.join(["Session_Time ", "O1", "note", "o2"])] + [separator.join([repr(float(i * step)), str(i), "a", str(-i)]) for i in order] + [separator.join(["", "1", "2", "3"]), separator.join(["9", "x", "", ""])]
    (tmp_path / "s.csv").write_text("\n".join(lines))
    rows = archives.read_continuous_csv(spark, f"file://{tmp_path}/s.csv", "session_time", ["o1", "O2"]).orderBy("i", "channel").collect()
    assert [(r.i, r.channel, r.x) for r in rows] == [(i, c, float(v)) for i in range(300) for c, v in (("O2", -i), ("o1", i))]
    assert rows[0].fs == pytest.approx(fs)


def test_csv_without_a_rate_or_rows_is_refused(spark, tmp_path):
    def read(lines, *columns):
        (tmp_path / "s.csv").write_text("\n".join(["t,c", *lines]))
        return archives.read_continuous_csv(spark, f"file://{tmp_path}/s.csv", "t", list(columns or ["c"]))

    with pytest.raises(ValueError, match="fewer than 10"):
        read([f"{i},1" for i in range(9)])
    with pytest.raises(ValueError, match="no plausible rate"):
        read([f"{i * 100000},1" for i in range(20)])
    with pytest.raises(ValueError, match="does not advance"):
        read(["1,1"] * 20)
    with pytest.raises(ValueError, match="missing"):
        read(["1,1"] * 20, "c", "cz")


def test_word_wrap(spark):
    from epochflow.functions.text import tail, wrapped

    def lines(text, width):
        df = spark.createDataFrame([(text,)], "t string")
        return df.select(wrapped(F.col("t"), width)).first()[0]

    assert lines("aa bb cc", 5) == ["aa bb", " cc"] and lines("abcdefgh ij", 3) == ["abc", "def", "gh ", "ij"]
    assert lines("", 4) == [""] and lines("  abcdef", 3) == ["abc", "def"] and lines(None, 4) is None
    many = spark.createDataFrame([("abcdefghij",)], "t string").select(tail(wrapped(F.col("t"), 2), 3), tail(wrapped(F.col("t"), 9), 3)).first()
    assert many[0] == ["ef", "gh", "ij"] and many[1] == ["abcdefghi", "j"]


def test_balanced_folds(spark):
    """Against a plain greedy loop; groups of one size go by name."""
    rng = random.Random(4)
    rows = [(k, g, rng.randrange(2)) for k in range(3) for g in range(9) for _ in range(rng.choice([1, 2, 2, 5, 9]))]
    df = spark.createDataFrame(rows, "k long, g long, y int")
    got = {(r.k, r.g): r.fold for r in learning.balanced_folds(df, ["k"], "g", 3).collect()}
    for k in range(3):
        n = Counter(g for key, g, _ in rows if key == k)
        loads = [0, 0, 0]
        for g, size in sorted(n.items(), key=lambda x: (-x[1], x[0])):
            at = loads.index(min(loads))
            loads[at] += size
            assert got[k, g] == at
    whole = df.join(spark.createDataFrame([(k, g, f) for (k, g), f in got.items()], "k long, g long, fold int"), ["k", "g"])
    for r in learning.complete_folds(whole, ["k"], "fold", "y").collect():
        sides = [{y for k, g, y in rows if k == r.k and (got[k, g] == r.fold) == held} for held in (True, False)]
        assert r.complete == (sides[0] == sides[1] == {0, 1})
        assert r.trials == sum(k == r.k and got[k, g] == r.fold for k, g, _ in rows)


def test_binomial_upper(spark):
    df = spark.createDataFrame([(k, n) for n in (1, 7, 40, 3000) for k in {0, 1, n // 2, n}], "k long, n long")
    for r in df.select("k", "n", stats.binomial_upper(F.col("k"), F.col("n")).alias("p")).collect():
        want = sum(math.comb(r.n, i) for i in range(r.k, r.n + 1)) / 2**r.n
        assert abs(r.p - want) < 1e-9


def test_permuted_labels(spark):
    """Classes that differ in spread are told apart by the true labels, hardly by shuffled ones; reruns agree."""
    rng = np.random.default_rng(2)
    rows = [(1, i, i // 10 % 4, i % 2, (rng.standard_normal((4, 40)) * np.array([[1 + 3 * (i % 2)], [1], [1], [4 - 3 * (i % 2)]])).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "s long, e long, f int, y int, signal array<array<double>>")
    got = [learning.permutation_scores(df, "s", "f", "y", "e", "csp_lda", 23).orderBy("round").collect() for _ in range(2)]
    assert got[0] == got[1] and [r.round for r in got[0]] == list(range(24))
    assert got[0][0].accuracy > 0.95 and sum(r.accuracy for r in got[0][1:]) / 23 < 0.65


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k, n in enumerate((1, 2, 3, 500, 20000)) for v in (rng.standard_normal(n).round(1 if k % 2 else 6))]
    df = spark.createDataFrame(rows + [(9, None)], "k long, v double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.8, 0.975, 1.0]
    got = {r.k: r.quantiles for r in stats.exact_quantile(df, ["k"], "v", shares).collect()}
    assert got.keys() == set(range(5))
    for k in range(5):
        assert np.allclose(got[k], np.quantile([v for j, v in rows if j == k], shares), atol=1e-12)
    whole = stats.exact_quantile(df, [], "v", shares).first().quantiles
    assert np.allclose(whole, np.quantile([v for _, v in rows], shares), atol=1e-12)


def test_places_and_chunks_of_a_hot_key(spark):
    df = spark.createDataFrame([("a" if i % 10 else "b", i * 3) for i in range(1000)], "k string, at long")
    got = windows.sample_index(df, ["k"], "at", span=50).orderBy("at").collect()
    seen = {"a": 0, "b": 0}
    for r in got:
        assert r.i == seen[r.k]
        seen[r.k] += 1
    chunks = windows.chunked(df.withColumn("i", df["at"] / 3), "i", 100, before=2, after=1).collect()
    assert sum(r.own for r in chunks) == 1000 and len(chunks) == 1000 + 10 * 3
    long = spark.createDataFrame([(0, i, float(i)) for i in range(4000)], "c long, i long, x double")
    fast = windows.hop_windows(long, ["c"], "i", "x", 3, 1).orderBy("k").collect()
    assert [r.signal for r in fast] == [[float(i), i + 1.0, i + 2.0] for i in range(3998)]


def test_robust_z_with_ties_a_hot_key_and_nulls(spark):
    from epochflow.operators import quality

    rng = np.random.default_rng(8)
    hot = np.where(rng.random(4000) < 0.9, 2.5, rng.normal(size=4000))  # nine of ten values are the same
    rows = [("hot", i, float(v)) for i, v in enumerate(hot)] + [("odd", i, float(v)) for i, v in enumerate(rng.normal(size=7))] + [("few", 0, 1.0), ("few", 1, 5.0), ("none", 0, None), ("odd", 9, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {(r["k"], r["i"]): r["z"] for r in quality.robust_z(df, ["k"], "v", least=3).collect()}
    assert len(got) == len(rows)
    assert all(got["hot", i] == 0.0 for i in range(4000))  # more than half agree, so there is no spread to compare with
    odd = np.array([v for k, _, v in rows if k == "odd" and v is not None])
    mid = np.median(odd)
    want = 0.6745 * (odd - mid) / np.median(np.abs(odd - mid))
    assert np.allclose([got["odd", i] for i in range(7)], want) and got["odd", 9] is None
    assert got["few", 0] == got["few", 1] == 0.0 and got["none", 0] == 0.0


def test_quantiles_of_mostly_equal_values(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([np.zeros(9000), rng.exponential(size=1000)])
    df = spark.createDataFrame([(float(x),) for x in rng.permutation(v)], "v double")
    shares = [0.0, 0.5, 0.8999, 0.95, 1.0]
    got = stats.exact_quantile(df, [], "v", shares).first()["quantiles"]
    assert np.allclose(got, np.quantile(v, shares), rtol=0, atol=1e-12)


def test_both_ends_and_halves_of_a_hot_key(spark):
    from epochflow.operators import joins

    rows = [(0, i, float(i * 7919 % 1000)) for i in range(1000)] + [(1, 1, 2.0), (1, 2, 1.0), (1, 3, 3.0), (2, 1, 0.0)]
    df = spark.createDataFrame(rows, "k int, i long, v double")
    ends = joins.both_ends(df, ["k"], ["v", "i"], 2)
    got = sorted((r["k"], r["v"]) for r in ends.collect())
    assert got == [(0, 0.0), (0, 1.0), (0, 998.0), (0, 999.0), (1, 1.0), (1, 2.0), (1, 3.0), (2, 0.0)]
    assert "WindowGroupLimit" in ends._jdf.queryExecution().toString()
    half = Counter((r["k"], r["half"]) for r in windows.halves(df, ["k"], "i").collect())
    assert half == {(0, 1): 500, (0, 2): 500, (1, 1): 1, (1, 2): 2, (2, 2): 1}
