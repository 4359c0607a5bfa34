"""Queries beyond SQL against plain numpy, written another way, on the small tables."""

import numpy as np
import pytest

from epochflow.functions import kernels as K
from epochflow.operators import learning, signals
from epochflow.plans.base import epochs, stream_windows
from epochflow.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trials(spark):
    rows = epochs(spark, SF).orderBy("epoch_id").collect()
    return np.array([r.epoch_id for r in rows]), np.array([r.label for r in rows]), np.array([r.signal for r in rows])


@pytest.fixture(scope="module")
def windows(spark):
    rows = stream_windows(spark, SF).orderBy("epoch_id").collect()
    return np.array([r.epoch_id for r in rows]), np.array([r.signal for r in rows])


def by_id(spark, name, *columns):
    return {r.epoch_id: [r[c] for c in columns] for r in QUERIES[name](spark, SF).collect()}


def largest_correlation(x, y):
    """By the eigenproblem Sxx^-1 Sxy Syy^-1 Syx."""
    x, y = x - x.mean(axis=0), y - y.mean(axis=0)
    m = np.linalg.solve(x.T @ x, x.T @ y) @ np.linalg.solve(y.T @ y, y.T @ x)
    return np.sqrt(np.linalg.eigvals(m).real.max())


def waves(f, n, fs=250.0, harmonics=4):
    t = np.arange(n) / fs
    return np.stack([w(2 * np.pi * f * h * t) for h in range(1, harmonics + 1) for w in (np.sin, np.cos)], axis=1)


def test_windows_are_the_stream(spark, windows):
    ids, x = windows
    assert x.shape[1:] == (5, 750) and len(ids) >= 4
    assert np.array_equal(x[0][:, 250:], x[1][:, :500])


def test_scores_of_windows(spark, windows):
    ids, x = windows
    got = by_id(spark, "h20_h18_fbcca", "s0", "s1", "best", "c0", "c1", "plain_best")
    for i, trial in zip(ids, x):
        plain = [largest_correlation(trial.T, waves(f, 750)) for f in (15.0, 20.0)]
        bands = [K.zero_phase(K.bandpass(4, low, 88.0, 250.0), trial[None])[0].T for low in (12.0, 22.0, 32.0)]
        scores = [sum(w * largest_correlation(b, waves(f, 750)) ** 2 for b, w in zip(bands, (1.0, 0.65, 0.45))) for f in (15.0, 20.0)]
        s0, s1, best, c0, c1, plain_best = got[i]
        assert np.allclose([s0, s1, c0, c1], [*scores, *plain], atol=1e-6)
        assert best == int(scores[1] > scores[0]) and plain_best == int(plain[1] > plain[0])
        assert 0 < s0 < 1 and abs(s0 - s1) > 1e-6


def test_scores_tell_frequencies_apart():
    rng = np.random.default_rng(0)
    t = np.arange(750) / 250
    x = np.stack([[np.sin(2 * np.pi * (15, 20)[k % 2] * t + c) + rng.standard_normal(750) for c in range(4)] for k in range(20)])
    s = K.fbcca(x, [15.0, 20.0], 250.0, [0, 1, 2, 3])
    assert (s.argmax(axis=1) == np.arange(20) % 2).all() and (K.cca(x, [15.0, 20.0], 250.0, [0, 1, 2, 3]).argmax(axis=1) == np.arange(20) % 2).all()
    with pytest.raises(ValueError):
        K.fbcca(x[..., :8], [15.0], 250.0, [0, 1])


def test_notch():
    t = np.arange(2500) / 250
    hum, tone = np.sin(2 * np.pi * 50 * t), np.sin(2 * np.pi * 12 * t)
    y = K.zero_phase(K.notch(50.0, 30.0, 250.0), np.stack([hum, tone, np.ones(2500)]))
    assert abs(y[0, 500:-500]).max() < 0.02 and abs(y[1] - tone)[500:-500].max() < 0.01 and np.allclose(y[2], 1)
    sos = K.notch(50.0, 30.0, 250.0)[0]
    z = np.exp(-2j * np.pi * np.array([50 - 50 / 60, 50, 50 + 50 / 60]) / 250)
    gain = np.abs((sos[0] + sos[1] * z + sos[2] * z * z) / (1 + sos[4] * z + sos[5] * z * z))
    assert gain[1] < 1e-12 and np.allclose(gain[[0, 2]], np.sqrt(0.5), atol=0.01)


def test_notched_windows(spark, windows):
    ids, x = windows
    got = {(r.epoch_id, r.ch): r.std for r in QUERIES["h9_notch"](spark, SF).collect()}
    y = K.zero_phase(K.notch(50.0, 30.0, 250.0), x)
    assert all(abs(got[i, c] - y[k, c].std()) < 1e-6 for k, i in enumerate(ids) for c in range(5))


def test_gate_is_the_kernel(spark, trials):
    ids, _, x = trials
    got = {(r.epoch_id, r.ch, r.s): r.y for r in QUERIES["h8_spectral_gate"](spark, SF).collect()}
    want = K.spectral_gate(x, 0.08)
    assert all(abs(got[i, c, s] - want[k, c, s]) < 2e-5 for k, i in enumerate(ids[:50]) for c in range(8) for s in range(8))


def test_signal_check_knows_a_square_wave(spark):
    t = np.arange(750) / 250
    square = np.sign(np.sin(2 * np.pi * 10 * t + 0.1)) * 50
    rng = np.random.default_rng(1)
    rows = [(0, [(square + rng.standard_normal(750)).tolist(), rng.standard_normal(750).tolist()]), (1, [np.sin(2 * np.pi * 10 * t).tolist()] * 2)]
    df = spark.createDataFrame(rows, "epoch_id long, signal array<array<double>>")
    got = {r.epoch_id: r.s for r in df.select("epoch_id", signals.shapes(df["signal"], 250.0, 10.0).alias("s")).collect()}
    assert got[0][0].shape == "square" and abs(got[0][0].ratio - 1 / 3) < 0.05 and got[1][0].shape == "sine"


def test_tangent_vectors(spark, trials):
    ids, _, x = trials
    got = by_id(spark, "d26_h25_a16_tangent", "features")
    c = K.covariances(x)
    whole = np.array([got[i][0] for i in ids])
    assert np.abs(whole.mean(axis=0)).max() < 1e-6  # logarithms at the Riemannian mean add up to nothing
    i, j = np.triu_indices(8)
    scale = np.where(i == j, 1.0, np.sqrt(2))
    for k in range(0, 40, 7):  # distances to the mean are those of generalised eigenvalues
        logs = np.zeros((8, 8))
        logs[i, j] = whole[k] / scale
        w = np.linalg.eigvalsh(logs + np.triu(logs, 1).T)
        assert abs(np.linalg.det(c[k]) / np.exp(w.sum()) / (np.linalg.det(c[0]) / np.exp(np.linalg.eigvalsh(_sym(whole[0], i, j, scale)).sum())) - 1) < 1e-6


def _sym(v, i, j, scale):
    m = np.zeros((8, 8))
    m[i, j] = v / scale
    return m + np.triu(m, 1).T


def test_spatial_filters(spark, trials):
    ids, y, x = trials
    c = K.covariances(x)
    a, b = c[y == 0].mean(axis=0), c[y == 1].mean(axis=0)
    w, v = np.linalg.eig(np.linalg.solve(a + b, a))
    order = np.argsort(w.real)
    filters = v.real[:, [*order[:2], *order[-2:]]].T
    got = by_id(spark, "d27_h23_csp", "features")
    for k in np.flatnonzero(np.isin(y, (0, 1))):
        # Variances under a filter are set up to its length, so each one's differences between trials are compared.
        var = np.log((filters @ x[k]).var(axis=1) / np.einsum("fc,cd,fd->f", filters, a + b, filters))
        share = np.exp(var) / np.exp(var).sum()
        assert np.allclose(np.exp(got[ids[k]][0]), share, atol=1e-6)


def test_task_related_components(spark, trials):
    ids, y, x = trials
    x = x - x.mean(axis=-1, keepdims=True)
    filters, templates = [], []
    for k in np.unique(y):
        t = x[y == k]
        s = sum(t[i] @ t[j].T for i in range(len(t)) for j in range(len(t)) if i != j)
        q = np.concatenate(list(t), axis=1)
        q = q @ q.T
        q = 0.95 * q + 0.05 * np.trace(q) / 8 * np.eye(8)
        w, v = np.linalg.eig(np.linalg.solve(q, s))
        f = v[:, w.real.argmax()].real
        filters.append(f / np.linalg.norm(f))
        templates.append(t.mean(axis=0))
    got = by_id(spark, "d28_h21_trca", "scores")
    for k in range(0, len(ids), 25):
        own = np.stack(filters)
        want = [np.corrcoef((own @ x[k]).ravel(), (own @ t).ravel())[0, 1] for t in templates]
        signs = [abs(r) * r for r in want]
        assert np.allclose(np.abs(got[ids[k]][0]), np.abs(signs), atol=1e-6)


def test_band_power_and_resampling(spark, trials):
    ids, _, x = trials
    power = {(r.epoch_id, r.ch): r.power for r in QUERIES["h22_d20_band_power"](spark, SF).collect()}
    up = {(r.epoch_id, r.ch): r.y for r in QUERIES["h10_resample"](spark, SF).collect()}
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(8) / 8)
    for k in range(0, len(ids), 31):
        for c in range(8):
            f = np.array([abs(sum((x[k, c, s] - x[k, c].mean()) * hann[s] * np.exp(-2j * np.pi * b * s / 8) for s in range(8))) ** 2 for b in range(5)])
            p = f / (250 * (hann**2).sum()) * [1, 2, 2, 2, 1]
            inside = [b for b in range(5) if 8 <= b * 250 / 8 <= 40]
            assert abs(power[ids[k], c] - p[inside].mean()) < 1e-9
            spec = np.array([sum(x[k, c, s] * np.exp(-2j * np.pi * b * s / 8) for s in range(8)) for b in range(-4, 5)])
            spec[[0, -1]] /= 2
            y = [sum(spec[b + 4] * np.exp(2j * np.pi * b * s / 16) for b in range(-4, 5)).real / 8 for s in range(16)]
            assert np.allclose(up[ids[k], c], y, atol=1e-9) and np.allclose(up[ids[k], c][::2], x[k, c], atol=1e-9)


def test_models_from_sums_are_the_direct_ones(spark, trials):
    ids, y, x = trials
    fold, two = ids // 10 % 5, y % 2
    df = spark.createDataFrame([(int(i), int(f), int(k), t.tolist()) for i, f, k, t in zip(ids, fold, two, x)], "epoch_id long, fold int, y int, signal array<array<double>>").repartition(6)
    got = {r.epoch_id: r.predicted for r in learning.held_out_csp_lda(df, "fold", 5, "y").collect()}
    for f in range(5):
        want = learning.csp_lda(x[fold != f], two[fold != f])(x[fold == f])
        assert [got[i] for i in ids[fold == f]] == want.tolist()
    one = df.where("y = 0")
    assert {r.predicted for r in learning.held_out_csp_lda(one, "fold", 5, "y").collect()} == {None}
    assert learning.held_out_csp_lda(df.limit(0), "fold", 5, "y").count() == 0


def test_cross_validation_counts(spark, trials):
    ids, y, x = trials
    fold, two, who = ids // 10 % 5, y % 2, ids // 250
    got = {(r.subject, r.fold): (r.n, r.correct) for r in QUERIES["k5_k7_cross_validation"](spark, SF).collect() if r.pipeline == "csp_lda"}
    for s in np.unique(who):
        for f in range(5):
            own = who == s
            want = learning.csp_lda(x[own & (fold != f)], two[own & (fold != f)])(x[own & (fold == f)])
            assert got[s, f] == ((own & (fold == f)).sum(), (want == two[own & (fold == f)]).sum())


def test_bootstrap_holds_the_mean(spark):
    import duckdb

    mean = dict(duckdb.sql(f"SELECT person, avg(score) FROM (SELECT o_custkey % 20 AS person, o_orderkey % 5 AS fold, avg(o_totalprice) AS score FROM '{SF}/orders.parquet' GROUP BY 1, 2) GROUP BY 1").fetchall())
    for r in QUERIES["d36_bootstrap"](spark, SF).collect():
        assert r.low <= mean[r.person] <= r.high and r.low < r.high


def test_saved_models_tell_as_fitted(spark, trials):
    ids, y, x = trials
    two, who = y % 2, ids // 250
    df = spark.createDataFrame([(int(i), int(w), int(k), t.tolist()) for i, w, k, t in zip(ids, who, two, x)], "epoch_id long, subject long, y int, signal array<array<double>>")
    for pipeline in ("csp_lda", "riemann_lda", "riemann_lr", "trca"):
        choice = spark.createDataFrame([(0, pipeline), (1, pipeline)], "subject long, pipeline string")
        got = {r.epoch_id: r.predicted for r in learning.applied(df, learning.refit(df, choice, "subject", "y"), "subject").collect()}
        for s in (0, 1):
            own = who == s
            assert [got[i] for i in ids[own]] == learning.PIPELINES[pipeline](x[own], two[own])(x[own]).tolist()
    rows = QUERIES["k7_k8_k10_models"](spark, SF).collect()
    assert {r.subject for r in rows} == {0, 1} and all(r.trials == 250 and 0.5 < r.on_own_trials <= 1 for r in rows)
