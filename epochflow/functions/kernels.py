"""Numpy kernels on batches of signals (last axis: time). Used inside Arrow batches; no Spark here."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Sub-bands (Hz) and weights of the filter bank, and the bands of the spectra.
SUB_BANDS, BAND_WEIGHTS, TOP_HZ = (12.0, 22.0, 32.0), (1.0, 0.65, 0.45), 88.0
#: Pass band of motor imagery, and the bands of its filter bank (Hz).
MOTOR_BAND, MOTOR_BANK = (8.0, 30.0), ((4.0, 8.0), (8.0, 12.0), (12.0, 16.0), (16.0, 20.0), (20.0, 26.0), (26.0, 32.0))
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 45), "broad": (1, 40)}


@lru_cache(maxsize=64)
def bandpass(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Butterworth band-pass as second-order sections (order, 6): analogue prototype, band transform, bilinear."""
    k = np.arange(1, order + 1)
    proto = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    half, centre = proto * (w2 - w1) / 2, np.sqrt(w1 * w2)
    root = np.sqrt(half**2 - centre**2 + 0j)
    analogue = np.concatenate([half + root, half - root])
    poles = (2 * fs + analogue) / (2 * fs - analogue)
    gain = ((w2 - w1) ** order * (2 * fs) ** order / np.prod(2 * fs - analogue)).real
    upper = sorted(poles[poles.imag > 1e-12], key=lambda p: (abs(p), p.real))
    real = sorted(poles[abs(poles.imag) <= 1e-12].real)
    sections = [[1, 0, -1, 1, -2 * p.real, abs(p) ** 2] for p in upper]
    sections += [[1, 0, -1, 1, -(p + q), p * q] for p, q in zip(real[::2], real[1::2])]
    out = np.array(sections, dtype=np.float64)
    out[0, :3] *= gain
    return out


@lru_cache(maxsize=16)
def notch(frequency: float, quality: float, fs: float) -> np.ndarray:
    """A second-order notch as one section: zeros on the unit circle, poles of the bandwidth frequency / quality."""
    w = 2 * np.pi * frequency / fs
    gain = 1 / (1 + np.tan(w / quality / 2))
    zeros = gain * np.array([1.0, -2 * np.cos(w), 1.0])
    return np.array([[*zeros, 1.0, -2 * gain * np.cos(w), 2 * gain - 1]])


def _run(sos: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sections one after another (direct form II transposed) over the last axis, all rows at once."""
    y = x.astype(np.float64).copy()
    for (b0, b1, b2, _, a1, a2), (z1, z2) in zip(sos, start):
        s1, s2 = z1 * x[..., 0], z2 * x[..., 0]
        for t in range(y.shape[-1]):
            v = y[..., t].copy()
            out = b0 * v + s1
            s1, s2 = b1 * v - a1 * out + s2, b2 * v - a2 * out
            y[..., t] = out
    return y


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filters forwards and backwards; ends are extended by reflection about the end points."""
    x = np.asarray(x, dtype=np.float64)
    taps = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    edge = min(3 * taps, x.shape[-1] - 1)
    start, scale = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        start.append((scale * (gain - b0), scale * (b2 - a2 * gain)))
        scale *= gain
    wide = np.concatenate([2 * x[..., :1] - x[..., edge:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -edge - 2 : -1]], axis=-1) if edge else x
    y = _run(sos, wide, np.array(start))
    y = _run(sos, y[..., ::-1], np.array(start))[..., ::-1]
    return y[..., edge : y.shape[-1] - edge]


def reference_bank(frequency: float, n: int, fs: float, harmonics: int = 4) -> np.ndarray:
    """(n, 2 * harmonics) sines and cosines."""
    angle = 2 * np.pi * frequency * np.arange(n)[:, None] * np.arange(1, harmonics + 1) / fs
    return np.stack([np.sin(angle), np.cos(angle)], axis=2).reshape(n, -1)


def canonical_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """The largest canonical correlation of two centred sets of columns, by QR and singular values."""
    parts = []
    for m in (x, y):
        q, r = np.linalg.qr(m - m.mean(axis=0))
        d = np.abs(np.diag(r))
        parts.append(q[:, d > 1e-10 * max(d.max(), 1e-300)])
    if not parts[0].size or not parts[1].size:
        return 0.0
    return float(min(1.0, np.linalg.svd(parts[0].T @ parts[1], compute_uv=False)[0]))


def fbcca(signals: np.ndarray, frequencies, fs: float, channels, harmonics: int = 4, bands=SUB_BANDS, weights=BAND_WEIGHTS, top: float = TOP_HZ) -> np.ndarray:
    """(rows, classes) filter-bank scores: weighted squared canonical correlations; each band is filtered once.

    Signals must be longer than the columns of both sides together, or every correlation is 1.
    """
    n = signals.shape[-1]
    if n <= 2 * harmonics + len(channels) + 1:
        raise ValueError(f"{n} samples are too few for {harmonics} harmonics of {len(channels)} channels")
    banks = [reference_bank(f, n, fs, harmonics) for f in frequencies]
    out = np.zeros((len(signals), len(banks)))
    for low, w in zip(bands, weights):
        banded = zero_phase(bandpass(4, low, min(top, 0.45 * fs), fs), signals[:, channels])
        for i, trial in enumerate(banded):
            for c, bank in enumerate(banks):
                out[i, c] += w * canonical_correlation(trial.T, bank) ** 2
    return out


def cca(signals: np.ndarray, frequencies, fs: float, channels, harmonics: int = 4) -> np.ndarray:
    """(rows, classes) largest canonical correlations with sines and cosines of each frequency."""
    banks = [reference_bank(f, signals.shape[-1], fs, harmonics) for f in frequencies]
    return np.array([[canonical_correlation(trial.T, b) for b in banks] for trial in signals[:, channels]])


def amplitude_spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """One-sided peak amplitudes; the constant and Nyquist parts are not doubled."""
    n = x.shape[-1]
    a = 2 * np.abs(np.fft.rfft(x)) / n
    a[..., 0] /= 2
    if n % 2 == 0:
        a[..., -1] /= 2
    return np.fft.rfftfreq(n, 1 / fs), a


def spectral_gate(x: np.ndarray, floor: float) -> np.ndarray:
    """Zeroes frequency bins whose amplitude is below the floor."""
    f = np.fft.rfft(x)
    return np.fft.irfft(np.where(amplitude_spectrum(x, 1.0)[1] < floor, 0, f), x.shape[-1])


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """Fourier resampling to n samples; a shared Nyquist bin is split or joined."""
    old = x.shape[-1]
    f = np.fft.rfft(x)
    keep = min(old, n)
    out = np.zeros((*x.shape[:-1], n // 2 + 1), dtype=complex)
    out[..., : keep // 2 + 1] = f[..., : keep // 2 + 1]
    if keep % 2 == 0 and old != n:
        out[..., keep // 2] *= 0.5 if n > old else 2
        if n < old:
            out[..., keep // 2] = out[..., keep // 2].real
    return np.fft.irfft(out, n) * (n / old)


def welch(x: np.ndarray, fs: float, segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Power spectral density: Hann segments, half overlapped, means removed."""
    segment = min(segment, x.shape[-1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    parts = np.stack([x[..., s : s + segment] for s in range(0, x.shape[-1] - segment + 1, max(1, segment // 2))], axis=-2)
    parts = (parts - parts.mean(axis=-1, keepdims=True)) * window
    p = (np.abs(np.fft.rfft(parts)) ** 2).mean(axis=-2) / (fs * (window**2).sum())
    p[..., 1 : -1 if segment % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(segment, 1 / fs), p


def band_power(x: np.ndarray, fs: float, band: tuple[float, float], segment: int = 256) -> np.ndarray:
    f, p = welch(x, fs, segment)
    return p[..., (f >= band[0]) & (f <= band[1])].mean(axis=-1)


def band_integral(x: np.ndarray, fs: float, bands, segment: int = 256) -> np.ndarray:
    """Trapezoid integrals of the density over [low, high) of each band, on a last axis; NaN with fewer than two bins."""
    f, p = welch(x, fs, segment)
    out = [np.trapezoid(p[..., m], f[m], axis=-1) if m.sum() >= 2 else np.full(x.shape[:-1], np.nan) for m in ((f >= low) & (f < high) for low, high in bands)]
    return np.stack(out, axis=-1)


def tone(x: np.ndarray, fs: float, low: float = 4.0, high: float = 45.0) -> dict:
    """The dominant tone of one channel: frequency (parabola on log power), amplitude, peak over median."""
    n = len(x)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    s = np.abs(np.fft.rfft((x - x.mean()) * w))
    f = np.fft.rfftfreq(n, 1 / fs)
    inside = np.flatnonzero((f >= low) & (f <= high))
    if not len(inside) or not s[inside].max() > 0:
        return {"frequency": 0.0, "amplitude": 0.0, "snr": 0.0}
    k = int(inside[np.argmax(s[inside])])
    rest = np.array([i for i in inside if abs(i - k) > 2])
    a, b, c = np.log(s[[max(k - 1, 0), k, min(k + 1, len(s) - 1)]] ** 2 + 1e-300)
    shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
    return {"frequency": float((k + shift) * fs / n), "amplitude": float(2 * s[k] / w.sum()), "snr": float(s[k] / max(np.median(s[rest]) if len(rest) else 0.0, 1e-12))}


def shape_of(x: np.ndarray, fs: float, fundamental: float) -> tuple[str, float]:
    """sine, square or noise by the third harmonic's share (a square wave has a third)."""
    f, a = amplitude_spectrum(x - x.mean(), fs)
    at = lambda hz: a[np.argmin(abs(f - hz))]
    first = at(fundamental)
    ratio = float(at(3 * fundamental) / first) if first > 0 else 0.0
    if first < 3 * np.median(a[1:]):
        return "noise", ratio
    return ("square" if 0.2 <= ratio <= 0.45 else "sine" if ratio < 0.1 else "noise"), ratio


def is_blink(frontal: np.ndarray, fs: float, limit: float = 100.0, band=(0.5, 8.0), order: int = 2) -> np.ndarray:
    """Whether raw frontal channels (rows, channels, time) go beyond the limit in the slow band."""
    return np.abs(zero_phase(bandpass(order, *band, fs), frontal)).max(axis=(1, 2)) > limit


def covariances(x: np.ndarray, shrink: float = 0.05) -> np.ndarray:
    """Centred, trace-normalised covariance of each trial, shrunk towards I / channels."""
    x = x - x.mean(axis=-1, keepdims=True)
    c = x @ x.transpose(0, 2, 1) / (x.shape[-1] - 1)
    c = c / np.maximum(np.trace(c, axis1=1, axis2=2), 1e-20)[:, None, None]
    n = x.shape[1]
    return (1 - shrink) * c + shrink * np.eye(n) / n


def matrix_function(m: np.ndarray, f) -> np.ndarray:
    """f of the eigenvalues of symmetric matrices."""
    w, v = np.linalg.eigh(m)
    return (v * f(np.maximum(w, 1e-12))[..., None, :]) @ np.swapaxes(v, -1, -2)


def tangent(c: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Upper triangles of log(M^-1/2 C M^-1/2), off-diagonals times root two."""
    white = matrix_function(mean, lambda w: w**-0.5)
    logs = matrix_function(white @ c @ white, np.log)
    i, j = np.triu_indices(mean.shape[0])
    return logs[..., i, j] * np.where(i == j, 1.0, np.sqrt(2))


def csp(c0: np.ndarray, c1: np.ndarray, m: int = 4) -> np.ndarray:
    """(m, channels) spatial filters: eigenvectors of C0 against C0 + C1, half from each end; of stacks of matrices, too."""
    white = matrix_function(c0 + c1, lambda w: w**-0.5)
    v = np.linalg.eigh(white @ c0 @ white)[1]  # by rising eigenvalues
    order = np.arange(v.shape[-1])
    return np.swapaxes(v[..., [*order[: m // 2], *order[-(m - m // 2) :]]], -1, -2) @ white


def log_variance_features(filters: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log of each filtered signal's share of the variance."""
    v = np.maximum((filters @ x).var(axis=-1), 1e-20)
    return np.log(v / v.sum(axis=-1, keepdims=True))


def trca(s: np.ndarray, q: np.ndarray, shrink: float = 0.05) -> np.ndarray:
    """The unit filter that makes trials alike: leading eigenvector of S against Q (shrunk)."""
    q = (1 - shrink) * q + shrink * np.trace(q) / len(q) * np.eye(len(q))
    white = matrix_function(q, lambda w: w**-0.5)
    w = white @ np.linalg.eigh(white @ s @ white)[1][:, -1]
    return w / np.linalg.norm(w)


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n > 1e-12 else 0.0


EULER = 0.57721566490153286


def digamma(n: np.ndarray) -> np.ndarray:
    """Of whole numbers from 1 on: harmonic numbers less Euler's constant, a series from 16 on."""
    small = np.cumsum(np.append(0.0, 1.0 / np.arange(1, 16))) - EULER
    m = np.maximum(np.asarray(n, dtype=np.float64), 1.0)
    series = np.log(m) - 1 / (2 * m) - 1 / (12 * m**2) + 1 / (120 * m**4) - 1 / (252 * m**6) + 1 / (240 * m**8)
    return np.where(m < 16, small[np.minimum(m, 16).astype(np.int64) - 1], series)


def mutual_information(x: np.ndarray, y: np.ndarray, neighbours: int = 3) -> np.ndarray:
    """Nats that each column of x tells of the classes y, by nearest neighbours on the sorted values; 0 at least.

    A value's radius is the distance to its k-th neighbour of its class (fewer in a small class); the values of all
    classes nearer than that are counted, the value itself included (equal ones, where the radius is 0). Classes of a
    single value are left out.
    """
    names, inverse, sizes = np.unique(y, return_inverse=True, return_counts=True)
    kept = sizes[inverse] > 1
    x, inverse, own = x[kept], inverse[kept], sizes[inverse[kept]]
    n, out = len(x), np.zeros(x.shape[1])
    if not n:
        return out
    known = np.minimum(neighbours, own - 1)
    for f, column in enumerate(x.T):
        radius = np.empty(n)
        for c in np.unique(inverse):
            at = np.flatnonzero(inverse == c)
            order = at[np.argsort(column[at], kind="stable")]
            v, k = column[order], known[at[0]]
            padded = np.concatenate([np.full(k, -np.inf), v, np.full(k, np.inf)])
            around = np.stack([np.abs(padded[k + j : k + j + len(v)] - v) for j in range(-k, k + 1) if j])
            radius[order] = np.partition(around, k - 1, axis=0)[k - 1]
        v = np.sort(column)
        within = _nearer(v, column, radius, True) - _nearer(v, column, radius, False)
        equal = np.searchsorted(v, column, "right") - np.searchsorted(v, column, "left")
        m = np.where(radius > 0, np.maximum(within, 1), equal)
        out[f] = max(0.0, digamma(np.array([n]))[0] + digamma(known).mean() - digamma(own).mean() - digamma(m).mean())
    return out


def _nearer(v: np.ndarray, at: np.ndarray, radius: np.ndarray, above: bool) -> np.ndarray:
    """Where the sorted values that are nearer than the radius end (or begin, below); sums may round across a value."""
    place = np.searchsorted(v, at + radius, "left") if above else np.searchsorted(v, at - radius, "right")
    while True:
        edge = v[np.clip(place - 1 if above else place, 0, len(v) - 1)]
        far = (place > 0 if above else place < len(v)) & (np.abs(edge - at) >= radius) & (edge > at if above else edge < at)
        beyond = v[np.clip(place if above else place - 1, 0, len(v) - 1)]
        near = (place < len(v) if above else place > 0) & (np.abs(beyond - at) < radius)
        if not (far | near).any():
            return place
        side = ("left", "right") if above else ("right", "left")
        place = np.where(far, np.searchsorted(v, edge, side[0]), np.where(near, np.searchsorted(v, beyond, side[1]), place))


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = 1.0, tolerance: float = 1e-10, most: int = 100) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear margin between y = 1 and y = -1 with hinge loss, by predictor-corrector interior steps.

    A step solves one system of the features' size, and some twenty steps settle any data. Of the offsets that serve
    equally well, the middle one.
    """
    basis, x = np.linalg.qr(x.T) if x.shape[1] > x.shape[0] else (None, x)
    if basis is not None:
        x = x.T
    n, d = x.shape
    wide = np.c_[x, np.ones(n)]
    ridge = np.diag(np.append(np.ones(d), 0.0))
    # a: multipliers, room: cost - a (kept apart, or it would round to 0), slack: beyond the margin, short: within it;
    # a * slack and room * short go to 0.
    a, room = np.full(n, cost / 2), np.full(n, cost / 2)
    beta = np.append(x.T @ (a * y), 0.0)
    m = y * (wide @ beta) - 1
    short = np.maximum(-m, 0) + 1
    slack = m + short
    for _ in range(most):
        gap = (a @ slack + room @ short) / (2 * n)
        far, lean, free = y * (wide @ beta) - 1 + short - slack, y @ a, x.T @ (a * y) - beta[:-1]
        if gap < tolerance and max(np.abs(far).max(), abs(lean), np.abs(free).max()) < 1e-7:
            break
        weight = 1 / (short / room + slack / a)
        system = ridge + wide.T @ (wide * weight[:, None])

        def solved(one: np.ndarray, two: np.ndarray) -> tuple:
            g = one / a - two / room - far
            step = np.linalg.solve(system, wide.T @ (y * g * weight) + np.append(free, lean))
            by = (g - y * (wide @ step)) * weight
            return step, by, (one - slack * by) / a, (two + short * by) / room

        def reach(by: np.ndarray, slacker: np.ndarray, shorter: np.ndarray) -> float:
            """How far all four stay positive, 1 at most."""
            return 1 / max(1.0, (-by / a).max(), (by / room).max(), (-slacker / slack).max(), (-shorter / short).max())

        _, by, slacker, shorter = solved(-a * slack, -room * short)
        t = reach(by, slacker, shorter)
        ahead = ((a + t * by) @ (slack + t * slacker) + (room - t * by) @ (short + t * shorter)) / (2 * n)
        aim = max(gap * (ahead / gap) ** 3, tolerance / 10)  # nearer to 0 the sums lose their digits
        step, by, slacker, shorter = solved(aim - a * slack - by * slacker, aim - room * short + by * shorter)
        t = 0.995 * reach(by, slacker, shorter)
        beta, a, room, slack, short = beta + t * step, a + t * by, room - t * by, slack + t * slacker, short + t * shorter
    w = beta[:-1]
    pull, above, below = y - x @ w, a > slack, room > short
    up, low = np.where(y > 0, below, above), np.where(y > 0, above, below)
    b = float((pull[up].max() + pull[low].min()) / 2) if up.any() and low.any() else float(beta[-1])
    return w if basis is None else basis @ w, b


def platt(sums, most: int = 100, least: float = 1e-5) -> tuple[float, float]:
    """(a, b) of the probabilities 1 / (1 + exp(a * margin + b)), by Newton steps with halving.

    sums(a, b): loss, its gradient by a and b, and its second derivatives aa, bb, ab, added up over all margins; the
    margins themselves stay where they are.
    """
    a, b = sums.start
    loss, ga, gb, haa, hbb, hab = sums(a, b)
    for _ in range(most):
        if abs(ga) < least and abs(gb) < least:
            break
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        step, slope = 1.0, ga * da + gb * db
        while step >= 1e-10:
            new = sums(a + step * da, b + step * db)
            if new[0] < loss + 1e-4 * step * slope:
                a, b = a + step * da, b + step * db
                loss, ga, gb, haa, hbb, hab = new
                break
            step /= 2
        else:
            break
    return a, b


class Margins:
    """The sums that platt() asks for, of margins in memory; targets are drawn in from 0 and 1 by the class sizes."""

    def __init__(self, margin: np.ndarray, positive: np.ndarray):
        hits = positive.sum()
        self.margin, self.start = margin, (0.0, float(np.log((len(margin) - hits + 1) / (hits + 1))))
        self.target = np.where(positive, (hits + 1) / (hits + 2), 1 / (len(margin) - hits + 2))

    def __call__(self, a: float, b: float) -> tuple:
        z = a * self.margin + b
        p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
        d1, d2 = self.target - p, p * (1 - p)
        loss = (self.target * z + np.logaddexp(0, -z)).sum()
        return loss, (self.margin * d1).sum(), d1.sum(), (self.margin**2 * d2).sum(), d2.sum(), (self.margin * d2).sum()


def filter_bank_trca(x: np.ndarray, y: np.ndarray, fs: float = 250.0, starts=SUB_BANDS, top: float = TOP_HZ, shrink: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, filters (bands, classes, channels), templates (bands, classes, channels, samples)) of classes of two trials or more."""
    classes = np.array([k for k in np.unique(y) if (y == k).sum() >= 2])
    filters, templates = [], []
    for low in starts:
        banded = zero_phase(bandpass(4, low, min(top, 0.45 * fs), fs), x)
        banded = banded - banded.mean(axis=-1, keepdims=True)
        sums = [(t.sum(axis=0), (t @ t.transpose(0, 2, 1)).sum(axis=0), len(t)) for t in (banded[y == k] for k in classes)]
        filters.append([trca(s @ s.T - q, q, shrink) for s, q, _ in sums])
        templates.append([s / n for s, _, n in sums])
    return classes, np.array(filters), np.array(templates)


def filter_bank_trca_scores(x: np.ndarray, filters: np.ndarray, templates: np.ndarray, fs: float = 250.0, starts=SUB_BANDS, weights=BAND_WEIGHTS, top: float = TOP_HZ) -> np.ndarray:
    """(rows, classes): over the bands, weighted signed squares of the correlation with each template through all filters."""
    out = np.zeros((len(x), templates.shape[1]))
    for low, weight, w, ts in zip(starts, weights, filters, templates):
        banded = zero_phase(bandpass(4, low, min(top, 0.45 * fs), fs), x)
        seen = (w @ (banded - banded.mean(axis=-1, keepdims=True))).reshape(len(x), -1)
        known = (w @ ts).reshape(len(ts), -1)
        seen, known = seen - seen.mean(axis=1, keepdims=True), known - known.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(seen, axis=1)[:, None] * np.linalg.norm(known, axis=1)
        r = np.where(norm > 1e-12, seen @ known.T / np.maximum(norm, 1e-300), 0.0)
        out += weight * np.sign(r) * r * r
    return out
