"""Mutual information, margins with probabilities, and the pipelines that use them, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochflow.functions import kernels as K
from epochflow.operators import information, learning

from test_operators import _trials


def brute_information(x, y, k=3):
    out = []
    keep = [i for i in range(len(y)) if (y == y[i]).sum() > 1]
    psi = lambda n: sum(1 / t for t in range(1, int(n))) - K.EULER
    for c in x.T:
        terms = []
        for i in keep:
            same = sorted(abs(c[j] - c[i]) for j in keep if j != i and y[j] == y[i])
            used = min(k, len(same))
            r = same[used - 1]
            m = sum(abs(c[j] - c[i]) < r for j in keep) if r > 0 else sum(c[j] == c[i] for j in keep)
            terms.append(psi(used) - psi(len(same) + 1) - psi(max(m, 1)))
        out.append(max(0.0, psi(len(keep)) + np.mean(terms)) if keep else 0.0)
    return np.array(out)


def made(n=90, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    y[0] = 7  # a class of one
    x = rng.standard_normal((n, 4))
    x[:, 0] += 2 * y
    x[: n // 2, 3] = 1.0  # half of a feature's values are equal
    return x, y


@pytest.mark.parametrize("k", [1, 3, 50])
def test_information_of_a_batch(k):
    x, y = made()
    got = K.mutual_information(x, y, k)
    assert np.allclose(got, brute_information(x, y, k), atol=1e-12)
    assert got[0] > got[1] or k == 50


def test_information_over_ranges_and_chunks(spark):
    x, y = made(120, 3)
    rows = [(f"f{j}", int(y[i]), float(x[i, j])) for i in range(len(y)) for j in range(4)] + [("f0", None, 1.0), ("f0", 1, None)]
    df = spark.createDataFrame(rows, "name string, label int, value double").repartition(7)
    for chunk in (10_000, 4):
        got = {r.name: r.mi for r in information.mutual_information(df, "name", "value", "label", 3, chunk).collect()}
        assert np.allclose([got[f"f{j}"] for j in range(4)], brute_information(x, y), atol=1e-9)


def test_digamma(spark):
    want = [sum(1 / t for t in range(1, n)) - K.EULER for n in (1, 2, 15, 16, 17, 1000)]
    assert np.allclose(K.digamma(np.array([1, 2, 15, 16, 17, 1000])), want, atol=1e-11)
    df = spark.createDataFrame([(n,) for n in (1, 2, 15, 16, 17, 1000)], "n long").coalesce(1)
    assert np.allclose([r[0] for r in df.select(information.digamma(F.col("n"))).collect()], want, atol=1e-11)


def test_margins_are_those_of_the_dual_problem():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 3))
    y = np.where(x[:, 0] + 0.3 * rng.standard_normal(60) > 0, 1.0, -1.0)
    w, b = K.support_vectors(x, y, 1.0, 1e-6)
    loss = lambda w, b: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    for _ in range(300):
        assert best <= loss(w + 0.05 * rng.standard_normal(3), b + 0.05 * rng.standard_normal()) + 1e-6


def test_sigmoid_of_planted_margins(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal(4000) * 2
    t = rng.random(4000) < 1 / (1 + np.exp(-1.5 * m + 0.4))
    a, b = K.platt(K.Margins(m, t))
    assert abs(a + 1.5) < 0.15 and abs(b - 0.4) < 0.15
    table = spark.createDataFrame([(float(x), bool(y)) for x, y in zip(m, t)] + [(None, True)], "m double, t boolean").cache()
    assert np.allclose(information.platt(table, "m", "t"), (a, b), atol=1e-6)
    p = 1 / (1 + np.exp(a * m + b))
    for low in np.arange(0, 1, 0.25):
        at = (p >= low) & (p < low + 0.25)
        assert abs(p[at].mean() - t[at].mean()) < 0.05
    table.unpersist()


def test_svm_probabilities_and_classes():
    rng = np.random.default_rng(5)
    y = np.arange(150) % 3
    x = rng.standard_normal((150, 4)) * 0.5
    x[np.arange(150), y] += 2
    m = learning.Svm().fit(x[:90], y[:90])
    p = m.probabilities(x[90:])
    assert ((p >= 0) & (p <= 1)).all() and np.allclose(p.sum(axis=1), 1)
    assert (m.predict(x[90:]) == y[90:]).mean() > 0.95 and (p.argmax(axis=1) == y[90:]).mean() > 0.95


def test_filter_bank_keeps_the_most_telling_features(spark):
    x, y = _trials(80)
    p = learning.trained("fbcsp", x, y)
    z = np.concatenate([K.log_variance_features(w, K.zero_phase(K.bandpass(4, *band, 250.0), x)) for w, band in zip(p["filters"], K.MOTOR_BANK)], axis=1)
    assert z.shape[1] == 24 and len(p["picked"]) == 12
    scores = brute_information(z, y)
    assert min(scores[p["picked"]]) >= max(np.delete(scores, p["picked"])) - 1e-12
    rows = [(1, int(i // 16), int(y[i]), x[i].tolist()) for i in range(len(y))]
    df = spark.createDataFrame(rows, "subject long, fold int, y long, signal array<array<double>>")
    cv = learning.cross_validate(df, "subject", "fold", "y", learning.MOTOR).groupBy("pipeline").agg(F.avg("accuracy").alias("a")).collect()
    assert {r.pipeline for r in cv} == set(learning.MOTOR) and all(r.a > 0.85 for r in cv)


def test_motor_pipelines_see_the_motor_band_only():
    rng = np.random.default_rng(8)
    y = np.arange(60) % 2
    x = rng.standard_normal((60, 8, 512))
    x[y == 0, 2] *= 0.35
    x[y == 1, 4] *= 0.35
    mains = x + 3 * np.sin(2 * np.pi * 100 * np.arange(512) / 250.0)  # outside of 8 to 30 Hz
    assert np.abs(learning.banded(mains - x)[..., 100:-100]).max() < 0.01
    for pipeline in ("csp_lda", "riemann_lr", "riemann_svm"):
        told = learning.PIPELINES[pipeline](x[:40], y[:40])
        assert (told(mains[40:]) == y[40:]).mean() > 0.8, pipeline


def test_filter_bank_trca_equals_a_plain_loop(spark):
    """Query scores of windows of 750 samples, against a loop over bands, classes and pairs of trials."""
    from epochflow.plans.analysis import _stream_trials
    from epochflow.plans.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = _stream_trials(spark, sf).orderBy("epoch_id").collect()
    ids, y, x = [r.epoch_id for r in rows], np.array([r.y for r in rows]), np.array([r.signal for r in rows])
    want = np.zeros((len(x), 2))
    for low, weight in ((12.0, 1.0), (22.0, 0.65), (32.0, 0.45)):
        b = K.zero_phase(K.bandpass(4, low, 88.0, 250.0), x)
        b = b - b.mean(axis=-1, keepdims=True)
        filters, templates = [], []
        for k in (0, 1):
            t = b[y == k]
            s = sum(t[i] @ t[j].T for i in range(len(t)) for j in range(len(t)) if i != j)
            q = sum(one @ one.T for one in t)
            q = 0.95 * q + 0.05 * np.trace(q) / len(q) * np.eye(len(q))
            values, vectors = np.linalg.eig(np.linalg.solve(q, s))
            filters.append(np.real(vectors[:, np.argmax(values.real)]))
            templates.append(t.mean(axis=0))
        w = np.array([f / np.linalg.norm(f) for f in filters])
        for i, one in enumerate(b):
            for k in (0, 1):
                # The sign of a filter is free, but the same in template and trial.
                r = np.corrcoef((w @ one).ravel(), (w @ templates[k]).ravel())[0, 1]
                want[i, k] += weight * np.sign(r) * r * r
    got = {r.epoch_id: r.scores for r in QUERIES["d28_h21_filter_bank_trca"](spark, sf).collect()}
    assert np.allclose([got[i] for i in ids], want, atol=1e-6)
    assert (want.argmax(axis=1) == y).mean() > 0.6


def test_models_of_the_stream_are_compared_on_one_fold_each(spark):
    from epochflow.plans.analysis import _stream_trials
    from epochflow.plans.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = _stream_trials(spark, sf).orderBy("epoch_id").collect()
    x, y, f = np.array([r.signal for r in rows]), np.array([r.y for r in rows]), np.array([r.fold for r in rows])
    hits, margins = [], []
    for held in np.unique(f):
        a = f == held
        if min(np.bincount(y[~a], minlength=2)) < 2:
            continue
        classes, filters, templates = K.filter_bank_trca(x[~a], y[~a])
        s = K.filter_bank_trca_scores(x[a], filters, templates)
        hits.append(classes[s.argmax(axis=1)] == y[a])
        margins.append(np.abs(s[:, 0] - s[:, 1]))
    got = {r.pipeline: r for r in QUERIES["k4_k9_d34_model_choice"](spark, sf).collect()}
    assert got["trca"].mean == pytest.approx(np.mean([h.mean() for h in hits])) and got["trca"].folds == len(hits)
    right, m = np.concatenate(hits), np.concatenate(margins)
    both = right.any() and not right.all()
    d = (m[right].mean() - m[~right].mean()) / np.sqrt((m[right].var() + m[~right].var()) / 2) if both else 0.0
    assert got["trca"].separation == pytest.approx(d, rel=1e-6)
    assert sum(r.winner for r in got.values()) == 1 and set(got) == {"fbcca", "trca"}


def test_calibrated_margins_of_the_tables(spark):
    from epochflow.plans.registry import QUERIES

    rows = QUERIES["d31_svm"](spark, "/root/testdata/sf0.01").collect()
    m, p = np.array([r.margin for r in rows]), np.array([r.probability for r in rows])
    assert ((p >= 0) & (p <= 1)).all() and all(r.prediction == (r.margin > 0) for r in rows)
    order = np.argsort(m)
    assert (np.diff(p[order]) >= -1e-12).all() or (np.diff(p[order]) <= 1e-12).all()


def test_a_saved_filter_keeps_its_band(spark, tmp_path):
    from epochflow.operators.estimators import BandpassFilter

    x, _ = _trials(3)
    df = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(x)], "i int, signal array<array<double>>")
    BandpassFilter(low=1.0, high=40.0).write().overwrite().save(f"file://{tmp_path}/filter")
    back = BandpassFilter.load(f"file://{tmp_path}/filter")
    got = np.array([r.filtered for r in back.transform(df).orderBy("i").collect()])
    assert np.allclose(got, K.zero_phase(K.bandpass(4, 1.0, 40.0, 250.0), x))


def test_task_sets_are_screened_by_limits_that_bind(spark):
    from epochflow.plans.registry import QUERIES

    rows = QUERIES["j2_k8_k13_task_set"](spark, "/root/testdata/sf0.01").collect()
    assert {r.pipeline for r in rows} == set(learning.MOTOR) and all(0 <= r["mean"] <= 1 for r in rows)
    by = {r.subject for r in rows}
    assert all(sum(r.winner for r in rows if r.subject == s) == 1 for s in by)


def test_purged_folds_share_no_sample(spark):
    rng = np.random.default_rng(7)
    n = 60
    x, y = rng.standard_normal((n, 5, 64)), np.arange(n) // 2 % 2
    fold = np.arange(n) // 10 % 3
    df = spark.createDataFrame([(1, int(fold[i]), int(y[i]), 100 + i, x[i].tolist()) for i in range(n)], "subject long, fold int, y long, k long, signal array<array<double>>")
    got = {(r.fold, r.purge): r for r in learning.purged_scores(df, "subject", "fold", "y", "k", 3, "csp_lda").collect()}
    for f in range(3):
        held = np.flatnonzero(fold == f)
        near = np.array([i for i in range(n) if fold[i] != f and min(abs(i - h) for h in held) < 3])
        for purge in (False, True):
            used = np.array([i for i in range(n) if fold[i] != f and not (purge and i in near)])
            told = learning.csp_lda(x[used], y[used])(x[held])
            r = got[f, purge]
            assert (r.n, r.correct) == (len(held), int((told == y[held]).sum()))
            assert (r.purged, r.shared) == ((len(near), 0) if purge else (0, len(near)))


def test_overlap_of_the_stream(spark):
    from epochflow.plans.registry import QUERIES

    for r in QUERIES["k17_overlap_leakage"](spark, "/root/testdata/sf0.01").collect():
        assert r.leaked > 0 and r.still_shared == 0 and r.purged > 0 and 0 <= r.naive <= 1
        assert r.gap == pytest.approx(r.naive - r.apart)


def test_quantiles_of_ties_and_hot_keys(spark):
    """Nine tenths of one key's values are equal, and one key holds nine tenths of the rows."""
    from epochflow.operators import stats

    rng = np.random.default_rng(4)
    v = np.where(rng.random(20_000) < 0.9, 0.0, rng.standard_normal(20_000))
    k = np.where(rng.random(20_000) < 0.9, 1, 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(k, v)], "k int, v double").repartition(8)
    shares = [0.0, 0.02, 0.05, 0.5, 0.951, 0.99, 1.0]
    got = {r.k: r.quantiles for r in stats.exact_quantile(df, ["k"], "v", shares).collect()}
    for key in (1, 2):
        assert np.allclose(got[key], np.quantile(v[k == key], shares), atol=1e-12)
    whole = stats.exact_quantile(df, [], "v", shares).first().quantiles
    assert np.allclose(whole, np.quantile(v, shares), atol=1e-12)


def test_margins_settle_on_classes_that_overlap():
    """Loss of the margins less the dual's value, of the multipliers that fit them: steps that stop early leave a gap."""
    rng = np.random.default_rng(3)
    for n, d in ((200, 36), (400, 10), (10, 40)):
        x, y = rng.standard_normal((n, d)), np.where(np.arange(n) % 2, 1.0, -1.0)
        w, b = K.support_vectors(x, y)
        loss = lambda w, b: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w + b)).sum()  # noqa: E731, B023
        # Where the margin is beyond 1 or within it, multipliers are 0 or 1; those at it must make w of what is left.
        m = y * (x @ w + b)
        at = np.abs(m - 1) < 1e-4
        left = np.append(w - x[~at & (m < 1)].T @ y[~at & (m < 1)], -y[~at & (m < 1)].sum())
        a = np.linalg.lstsq(np.c_[x[at], np.ones(at.sum())].T * y[at], left, rcond=None)[0]
        assert np.allclose(np.c_[x[at], np.ones(at.sum())].T @ (a * y[at]), left, atol=1e-4)
        assert all(loss(w, b) <= loss(w + 1e-3 * rng.standard_normal(d), b + 1e-3 * rng.standard_normal()) + 1e-5 for _ in range(50))


def test_people_of_small_tables_are_fitted_in_several_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [(u, i % 4, i // 2 % 2, rng.standard_normal((3, 16)).tolist()) for u in range(12) for i in range(16)]
    df = spark.createDataFrame(rows, "s long, f int, y int, signal array<array<double>>")
    cv = learning.cross_validate(df, "s", "f", "y", ["csp_lda"]).withColumn("task", F.spark_partition_id()).collect()
    assert len(cv) == 48 and len({r.task for r in cv}) > 1


def test_what_is_made_of_each_trial_goes_along_with_its_folds():
    x, y = _trials(40)
    whole, rows = learning.Trials(x).made(learning.MOTOR), np.arange(0, 40, 3)
    part, alone = whole[rows], learning.Trials(x[rows])
    assert set(part._made) == {"banded", "covariances", "bank", "bank_covariances"}
    assert np.array_equal(part.covariances, alone.covariances) and np.array_equal(part.mean, alone.mean)
    assert all(np.array_equal(a, b) for a, b in zip(part.bank, alone.bank))
    for p in learning.PIPELINES.keys() - {"fbcca"}:
        assert np.array_equal(learning.PIPELINES[p](part, y[rows])(whole), learning.PIPELINES[p](x[rows], y[rows])(x))


def test_shuffles_side_by_side_equal_one_fit_each():
    x, y = _trials(40)
    fold = np.arange(40) // 4 % 5
    labels = np.stack([np.random.default_rng(m).permutation(y) for m in range(12)] + [np.where(np.arange(40) == 1, 1, 0)])
    hits, n = learning._csp_lda_hits(learning.Trials(x), fold, labels)
    for i, z in enumerate(labels):
        folds = [f for f in range(5) if len(np.unique(z[fold != f])) == 2]
        assert n[i] == sum((fold == f).sum() for f in folds)
        assert hits[i] == sum((learning.csp_lda(x[fold != f], z[fold != f])(x[fold == f]) == z[fold == f]).sum() for f in folds)


def _python_stages(df):
    """How many functions' workers a task of the plan needs at once."""
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def test_filter_bank_features_need_one_worker_and_equal_a_plain_loop(spark):
    from epochflow.plans.base import epochs
    from epochflow.plans.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    df = QUERIES["h24_filter_bank_features"](spark, sf)
    assert _python_stages(df) == 1
    rows = epochs(spark, sf).where("label in (0, 1)").orderBy("epoch_id").collect()
    x, y = np.array([r.signal for r in rows]), np.array([r.label for r in rows])
    want = []
    for band in K.MOTOR_BANK:
        b = K.zero_phase(K.bandpass(4, *band, 250.0), x)
        c = K.covariances(b)
        want.append(K.log_variance_features(K.csp(c[y == 0].mean(axis=0), c[y == 1].mean(axis=0)), b))
    got = [r.features for r in df.orderBy("epoch_id").collect()]
    assert np.allclose(got, np.concatenate(want, axis=1), atol=1e-8)


def test_functions_of_signals_share_a_worker(spark):
    """Band-pass, covariances and tangent vectors of more trials than a slice, with null among them."""
    from epochflow.operators import signals, spatial

    x = np.random.default_rng(5).standard_normal((1_200, 3, 16))
    df = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(x)], "i int, signal array<array<double>>").coalesce(1)
    banded = signals.bandpassed(F.col("signal"), 250.0, 8.0, 30.0)
    mean = K.covariances(K.zero_phase(K.bandpass(4, 8.0, 30.0, 250.0), x)).mean(axis=0)
    out = spatial.tangent_features(df.select("i", signals.covariance(banded).alias("cov")), mean).select("i", "features")
    assert _python_stages(out) == 1
    want = K.tangent(K.covariances(K.zero_phase(K.bandpass(4, 8.0, 30.0, 250.0), x)), mean)
    assert np.allclose([r.features for r in out.orderBy("i").collect()], want)
    some = df.withColumn("signal", F.when(F.col("i") % 2 == 0, F.col("signal"))).select("i", signals.covariance(F.col("signal")).alias("c"))
    assert all((r.c is None) == (r.i % 2 == 1) for r in some.collect())
