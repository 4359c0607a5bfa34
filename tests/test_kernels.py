import numpy as np
import pytest

from epochflow.functions import kernels as K

FS = 250.0
T = np.arange(750) / FS


def tone(f, n=750):
    return np.sin(2 * np.pi * f * np.arange(n) / FS)


def test_bandpass_gain_phase_and_stability():
    sos = K.bandpass(4, 8.0, 30.0, FS)
    for p in sos:
        assert (np.abs(np.roots(p[3:])) < 1).all()
    x = np.stack([tone(f, 2000) for f in (2, 15, 60)])
    y = K.zero_phase(sos, x)[:, 500:1500]
    gain = y.std(axis=1) / x[:, 500:1500].std(axis=1)
    assert gain[0] < 0.01 and gain[1] == pytest.approx(1, abs=0.02) and gain[2] < 0.02
    assert np.corrcoef(y[1], x[1, 500:1500])[0, 1] > 0.9999
    impulse = np.zeros(1001)
    impulse[500] = 1
    h = K.zero_phase(sos, impulse)
    assert np.allclose(h, h[::-1], atol=1e-9)


def test_fbcca_finds_the_tone_and_rejects_noise():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, 8, 750)) * 0.5
    x[:3, 6:] += tone(15)
    x[3:, 6:] += tone(20)
    scores = K.fbcca(x, [15.0, 20.0], FS, [6, 7])
    assert (scores.argmax(axis=1) == [0, 0, 0, 1, 1, 1]).all()
    idle = K.fbcca(rng.standard_normal((6, 8, 750)), [15.0, 20.0], FS, [6, 7])
    assert idle.max() < scores.max(axis=1).min()
    pure = K.canonical_correlation(np.stack([tone(15), tone(15) * 2 + tone(40) * 0]).T, K.reference_bank(15.0, 750, FS))
    assert pure == pytest.approx(1.0, abs=1e-9)


def test_spectra():
    x = 3 + 2 * tone(10)
    f, a = K.amplitude_spectrum(x, FS)
    assert a[0] == pytest.approx(3) and a[np.argmin(abs(f - 10))] == pytest.approx(2, abs=1e-9)
    f, p = K.welch(x - 3, FS, 256)
    assert abs(f[p.argmax()] - 10) < 1 and p.sum() * (f[1] - f[0]) == pytest.approx(2.0, rel=0.05)
    got = K.tone(x, FS)
    assert got["frequency"] == pytest.approx(10, abs=0.02) and got["snr"] > 30
    assert K.shape_of(np.sign(tone(9.0, 1000)), FS, 9.0)[0] == "square" and K.shape_of(tone(9.0, 1000), FS, 9.0)[0] == "sine"
    assert np.allclose(K.spectral_gate(x, 0.5), x, atol=1e-9)


def test_resample_keeps_a_tone():
    x = tone(5, 500)
    up = K.resample(x, 1000)
    assert np.allclose(up[::2], x, atol=1e-9) and np.allclose(K.resample(up, 500), x, atol=1e-9)


def test_blink_is_seen_on_raw_signals_only():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2, 2, 750)) * 5
    x[1, :, 300:338] += 220 * np.hanning(38)
    assert K.is_blink(x, FS).tolist() == [False, True]
    assert not K.is_blink(K.zero_phase(K.bandpass(4, 6.0, 40.0, FS), x), FS, limit=180).any()


def test_covariance_geometry():
    rng = np.random.default_rng(2)
    c = K.covariances(rng.standard_normal((10, 4, 60)))
    assert np.allclose(np.trace(c, axis1=1, axis2=2), 1) and (np.linalg.eigvalsh(c) > 0).all()
    assert np.allclose(K.tangent(c[:1], c[0]), 0, atol=1e-9)
    w = K.csp(c[:5].mean(axis=0), c[5:].mean(axis=0), 4)
    both = w @ (c[:5].mean(axis=0) + c[5:].mean(axis=0)) @ w.T
    assert np.allclose(both, np.eye(4), atol=1e-8)


def test_trca_sums_equal_the_pairs():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6, 3, 50)) + np.sin(np.arange(50) / 3)
    x -= x.mean(axis=-1, keepdims=True)
    pairs = sum(x[i] @ x[j].T for i in range(6) for j in range(6) if i != j)
    q = (x @ x.transpose(0, 2, 1)).sum(axis=0)
    assert np.allclose(pairs, x.sum(axis=0) @ x.sum(axis=0).T - q)
    assert np.linalg.norm(K.trca(pairs, q)) == pytest.approx(1)
