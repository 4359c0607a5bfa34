"""Pipelines under grouped cross-validation: a user's epochs are sent once, to one task for all folds and pipelines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochflow.functions import kernels as K
from epochflow.operators.signals import stack


#: Sampling rate that the pipelines' filters are made for, and features that the filter bank keeps.
FS, BEST_FEATURES = 250.0, 12


class Lda:
    """Linear discriminant with Ledoit-Wolf shrinkage of the pooled covariance."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Lda:
        classes = np.unique(y)
        means = np.stack([x[y == c].mean(axis=0) for c in classes])
        z = x - means[np.searchsorted(classes, y)]
        return self.of_moments(classes, np.array([(y == c).sum() for c in classes]), means, z.T @ z, (z**2).T @ (z**2))

    def of_moments(self, classes: np.ndarray, counts: np.ndarray, means: np.ndarray, second: np.ndarray, fourth: np.ndarray) -> Lda:
        """From counts and means of the classes, and sums of products of centred features and of their squares.

        Leading axes of all but the classes are fits side by side.
        """
        self.classes, self.means = classes, means
        n, d = counts.sum(axis=-1)[..., None, None], means.shape[-1]
        s = second / n
        flat = (np.trace(s, axis1=-2, axis2=-1) / d)[..., None, None] * np.eye(d)
        total = lambda m: m.sum(axis=(-2, -1), keepdims=True)
        spread = total((s - flat) ** 2)
        noise = np.minimum(spread, total(fourth / n - s**2) / n)
        a = np.where(spread > 0, noise / np.where(spread > 0, spread, 1.0), 1.0)
        self.inverse = np.linalg.pinv((1 - a) * s + a * flat)
        self.priors = np.log(counts / n[..., 0])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        w = self.means @ self.inverse
        return self.classes[np.argmax(x @ np.swapaxes(w, -1, -2) + (self.priors - 0.5 * (w * self.means).sum(axis=-1))[..., None, :], axis=-1)]


class Logistic:
    """Standardised multinomial logistic regression with an L2 penalty, by gradient steps."""

    def __init__(self, penalty: float = 1.0, steps: int = 200):
        self.penalty, self.steps = penalty, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.classes = np.unique(y)
        self.mean, self.scale = x.mean(axis=0), np.where(x.std(axis=0) < 1e-8, 1.0, x.std(axis=0))
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        t = (y[:, None] == self.classes).astype(float)
        self.w = np.zeros((z.shape[1], len(self.classes)))
        rate = 1.0 / (0.25 * np.linalg.norm(z, 2) ** 2 + self.penalty)
        for _ in range(self.steps):
            p = z @ self.w
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            self.w -= rate * (z.T @ (p - t) + self.penalty * np.r_[self.w[:-1], np.zeros((1, len(self.classes)))])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[np.argmax(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.w, axis=1)]


def _mean(c: np.ndarray) -> np.ndarray:
    m = c.mean(axis=0)
    for _ in range(20):
        white, root = K.matrix_function(m, lambda w: w**-0.5), K.matrix_function(m, np.sqrt)
        step = K.matrix_function(white @ c @ white, np.log).mean(axis=0)
        w, v = np.linalg.eigh(step)
        m = root @ ((v * np.exp(w)) @ v.T) @ root
        if np.linalg.norm(step) < 1e-8:
            break
    return m


class Svm:
    """Standardised linear margins between each two classes, with Platt's probabilities from out-of-fold margins."""

    def fit(self, x: np.ndarray, y: np.ndarray, folds: int = 5) -> Svm:
        self.classes = np.unique(y)
        self.mean, self.scale = x.mean(axis=0), np.where(x.std(axis=0) < 1e-8, 1.0, x.std(axis=0))
        z, weights, offsets, sigmoids = (x - self.mean) / self.scale, [], [], []
        for one, other in self.pairs():
            at = np.flatnonzero((y == one) | (y == other))
            sign, rows = np.where(y[at] == other, 1.0, -1.0), z[at]
            w, b = K.support_vectors(rows, sign)
            margins = rows @ w + b
            # Folds keep the classes' shares: trials of a class are dealt in turn.
            fold = np.zeros(len(at), dtype=np.int64)
            for c in (-1.0, 1.0):
                fold[sign == c] = np.arange((sign == c).sum()) % folds
            for f in range(folds):
                held = fold == f
                if held.any() and len(np.unique(sign[~held])) == 2:
                    v, c = K.support_vectors(rows[~held], sign[~held])
                    margins[held] = rows[held] @ v + c
            weights.append(w)
            offsets.append(b)
            sigmoids.append(K.platt(K.Margins(margins, sign > 0)))
        self.w, self.b, self.sigmoid = np.array(weights), np.array(offsets), np.array(sigmoids)
        return self

    def pairs(self) -> list[tuple]:
        return [(a, b) for i, a in enumerate(self.classes) for b in self.classes[i + 1 :]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes): each pair's probabilities, averaged; they add up to 1."""
        z = ((x - self.mean) / self.scale) @ self.w.T + self.b
        p = 1 / (1 + np.exp(np.clip(self.sigmoid[:, 0] * z + self.sigmoid[:, 1], -500, 500)))
        out = np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(self.pairs()):
            out[:, np.searchsorted(self.classes, b)] += p[:, k]
            out[:, np.searchsorted(self.classes, a)] += 1 - p[:, k]
        return out / out.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The class that wins most pairs by the margin's sign; ties go to the first."""
        z = ((x - self.mean) / self.scale) @ self.w.T + self.b
        votes = np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(self.pairs()):
            votes[np.arange(len(x)), np.where(z[:, k] > 0, np.searchsorted(self.classes, b), np.searchsorted(self.classes, a))] += 1
        return self.classes[np.argmax(votes, axis=1)]


def banded(x: np.ndarray) -> np.ndarray:
    """Trials in the pass band that opens the motor pipelines."""
    return K.zero_phase(K.bandpass(4, *K.MOTOR_BAND, FS), x)


def _bank(x: np.ndarray) -> list[np.ndarray]:
    return [K.zero_phase(K.bandpass(4, *band, FS), x) for band in K.MOTOR_BANK]


class Trials:
    """Trials with what pipelines make of each alone, made once for all folds: t[rows] takes along what is there.

    mean and tangent belong to the set as a whole, so they are made anew for each.
    """

    def __init__(self, x: np.ndarray, made: dict | None = None):
        self.x, self._made, self._mean = x, made or {}, None

    @classmethod
    def of(cls, x: np.ndarray | Trials) -> Trials:
        return x if isinstance(x, Trials) else cls(x)

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, rows: np.ndarray) -> Trials:
        return Trials(self.x[rows], {k: [v[rows] for v in vs] for k, vs in self._made.items()})

    def _once(self, name: str, make: Callable[[], list]) -> list:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def banded(self) -> np.ndarray:
        return self._once("banded", lambda: [banded(self.x)])[0]

    @property
    def covariances(self) -> np.ndarray:
        return self._once("covariances", lambda: [K.covariances(self.banded)])[0]

    @property
    def bank(self) -> list[np.ndarray]:
        return self._once("bank", lambda: _bank(self.x))

    @property
    def bank_covariances(self) -> list[np.ndarray]:
        return self._once("bank_covariances", lambda: [K.covariances(b) for b in self.bank])

    def made(self, pipelines: list[str]) -> Trials:
        """The same, with what these pipelines ask of each trial made at once, so that every fold takes it along."""
        for pipeline in pipelines:
            if pipeline == "fbcsp":
                self.bank_covariances
            elif pipeline == "csp_lda" or pipeline.startswith("riemann"):
                self.covariances
        return self

    @property
    def mean(self) -> np.ndarray:
        if self._mean is None:
            self._mean = _mean(self.covariances)
        return self._mean


def _bank_features(x: Trials, filters: np.ndarray) -> np.ndarray:
    return np.concatenate([K.log_variance_features(w, b) for w, b in zip(filters, x.bank)], axis=1)


def _lda(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    m = Lda().fit(x, y)
    return {"classes": m.classes, "means": m.means, "inverse": m.inverse, "priors": m.priors}


def _told(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    m = Lda()
    m.classes, m.means, m.inverse, m.priors = p["classes"], p["means"], p["inverse"], p["priors"]
    return m.predict(x)


def trained(pipeline: str, x: np.ndarray | Trials, y: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters of a fitted pipeline, as named arrays."""
    t = Trials.of(x)
    if pipeline == "fbcsp":
        a, b = np.unique(y)[:2]
        filters = np.stack([K.csp(c[y == a].mean(axis=0), c[y == b].mean(axis=0)) for c in t.bank_covariances])
        z = _bank_features(t, filters)
        picked = np.sort(np.argsort(-K.mutual_information(z, y), kind="stable")[:BEST_FEATURES])
        return {"filters": filters, "picked": picked, **_lda(z[:, picked], y)}
    if pipeline == "csp_lda":
        c = t.covariances
        a, b = np.unique(y)[:2]
        w = K.csp(c[y == a].mean(axis=0), c[y == b].mean(axis=0))
        return {"filters": w, **_lda(K.log_variance_features(w, t.banded), y)}
    if pipeline in ("riemann_lr", "riemann_lda", "riemann_svm"):
        z = K.tangent(t.covariances, t.mean)
        if pipeline == "riemann_lda":
            return {"mean": t.mean, **_lda(z, y)}
        if pipeline == "riemann_svm":
            s = Svm().fit(z, y)
            return {"mean": t.mean, "centre": s.mean, "scale": s.scale, "classes": s.classes, "w": s.w, "b": s.b, "sigmoid": s.sigmoid}
        m = Logistic().fit(z, y)
        return {"mean": t.mean, "centre": m.mean, "scale": m.scale, "classes": m.classes, "w": m.w}
    if pipeline == "trca":
        return dict(zip(("classes", "filters", "templates"), K.filter_bank_trca(t.x, y, FS)))
    raise ValueError(pipeline)


def told(pipeline: str, p: dict[str, np.ndarray], x: np.ndarray | Trials) -> np.ndarray:
    """The classes that a fitted pipeline tells."""
    t = Trials.of(x)
    if pipeline == "fbcsp":
        return _told(p, _bank_features(t, p["filters"])[:, p["picked"].astype(np.int64)])
    if pipeline == "csp_lda":
        return _told(p, K.log_variance_features(p["filters"], t.banded))
    if pipeline == "riemann_lda":
        return _told(p, K.tangent(t.covariances, p["mean"]))
    if pipeline == "riemann_svm":
        return margins_of(p).predict(K.tangent(t.covariances, p["mean"]))
    if pipeline == "riemann_lr":
        m = Logistic()
        m.mean, m.scale, m.classes, m.w = p["centre"], p["scale"], p["classes"], p["w"]
        return m.predict(K.tangent(t.covariances, p["mean"]))
    return p["classes"][np.argmax(K.filter_bank_trca_scores(t.x, p["filters"], p["templates"], FS), axis=1)]


def margins_of(p: dict[str, np.ndarray]) -> Svm:
    """The fitted margins among a pipeline's parameters."""
    m = Svm()
    m.mean, m.scale, m.classes, m.w, m.b, m.sigmoid = (p[k] for k in ("centre", "scale", "classes", "w", "b", "sigmoid"))
    return m


def _fit(pipeline: str) -> Callable:
    def fit(x: np.ndarray | Trials, y: np.ndarray) -> Callable[[np.ndarray | Trials], np.ndarray]:
        p = trained(pipeline, x, y)
        return lambda new: told(pipeline, p, new)

    return fit


csp_lda, fbcsp, riemann_svm, riemann_lr, riemann_lda, trca_templates = map(_fit, ("csp_lda", "fbcsp", "riemann_svm", "riemann_lr", "riemann_lda", "trca"))


def refit(epochs: DataFrame, choice: DataFrame, user: str, label: str, signal: str = "signal") -> DataFrame:
    """(user, pipeline, trials, model): the pipeline that `choice` (user, pipeline) names, fitted anew on all of a user's epochs.

    model: the parameters as JSON. Users with fewer than two classes have none.
    """

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["_y"].notna()]
        y, rows = part["_y"].to_numpy(dtype=np.int64), []
        if len(np.unique(y)) >= 2:
            pipeline = part["pipeline"].iloc[0]
            p = trained(pipeline, stack(part["_x"]), y)
            rows = [(int(part[user].iloc[0]), pipeline, len(y), json.dumps({k: v.tolist() for k, v in p.items()}))]
        return pd.DataFrame(rows, columns=[user, "pipeline", "trials", "model"])

    rows = epochs.select(user, F.col(label).cast("bigint").alias("_y"), F.col(signal).alias("_x")).join(choice.select(user, "pipeline"), user)
    return rows.groupBy(user).applyInPandas(fit, f"{user} bigint, pipeline string, trials bigint, model string")


def applied(epochs: DataFrame, models: DataFrame, user: str, signal: str = "signal", out: str = "predicted") -> DataFrame:
    """Adds what each user's model tells; users without one are left out."""

    @F.pandas_udf("bigint")
    def tell(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, texts, x in batches:
            found = pd.Series(0, index=x.index, dtype="int64")
            for text in texts.unique():
                at = texts == text
                p = {k: np.array(v) for k, v in json.loads(text).items()}
                found[at] = told(names[at].iloc[0], p, stack(x[at]))
            yield found

    return epochs.join(models.select(user, "pipeline", "model"), user).withColumn(out, tell("pipeline", "model", signal)).drop("model")


def fbcca_classes(x: np.ndarray | Trials, y: np.ndarray, frequencies=(15.0, 20.0), fs: float = 250.0) -> Callable[[np.ndarray | Trials], np.ndarray]:
    """The class of the frequency with the best filter-bank score; nothing is learned but which classes there are."""
    names = np.unique(y)
    return lambda new: names[np.argmax(K.fbcca(Trials.of(new).x, frequencies[: len(names)], fs, list(range(Trials.of(new).x.shape[1]))), axis=1)]


PIPELINES: dict[str, Callable] = {"fbcca": fbcca_classes, "csp_lda": csp_lda, "fbcsp": fbcsp, "riemann_svm": riemann_svm, "riemann_lr": riemann_lr, "riemann_lda": riemann_lda, "trca": trca_templates}
#: The motor-imagery pipelines that users choose from.
MOTOR = ["csp_lda", "fbcsp", "riemann_svm", "riemann_lr"]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key over as many tasks as shuffles have: fits take long for their few bytes, so tasks must not be joined by size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cross_validate(epochs: DataFrame, user: str, fold: str, label: str, pipelines: list[str], signal: str = "signal", least: int = 4) -> DataFrame:
    """(user, pipeline, fold, n, correct, accuracy) of one fit each; folds must keep groups whole.

    A user's epochs are sent once, to one task that fits every fold and pipeline: a fit needs them together, and one
    person's calibration is small by nature. Filters and covariances are made once a trial, Riemannian means once a
    fold. Folds with fewer than two classes or `least` trials to learn from give no
    row.
    """
    rows = epochs.select(user, F.col(fold).cast("int").alias("_f"), F.col(label).cast("bigint").alias("_y"), F.col(signal).alias("_x")).where("_y IS NOT NULL")

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        f, y, x, out = part["_f"].to_numpy(), part["_y"].to_numpy(dtype=np.int64), Trials(stack(part["_x"])).made(pipelines), []
        for held in np.unique(f):
            apart = f == held
            if (~apart).sum() >= least and len(np.unique(y[~apart])) >= 2:
                known, new = x[~apart], x[apart]
                for pipeline in pipelines:
                    hits = int((PIPELINES[pipeline](known, y[~apart])(new) == y[apart]).sum())
                    out.append((int(key[0]), pipeline, int(held), int(apart.sum()), hits, hits / int(apart.sum())))
        return pd.DataFrame(out, columns=[user, "pipeline", "fold", "n", "correct", "accuracy"])

    return dealt(rows, user).groupBy(user).applyInPandas(fit, f"{user} bigint, pipeline string, fold int, n bigint, correct bigint, accuracy double")


def _scores(pipeline: str, x: np.ndarray, y: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, scores (rows, classes)) of new trials, learned from x and y, of a pipeline that scores."""
    if pipeline == "trca":
        classes, filters, templates = K.filter_bank_trca(x, y, FS)
        return classes, K.filter_bank_trca_scores(new, filters, templates, FS)
    classes = np.unique(y)
    return classes, K.fbcca(new, (15.0, 20.0)[: len(classes)], FS, list(range(new.shape[1])))


def held_out_scores(epochs: DataFrame, user: str, fold: str, label: str, pipelines: list[str], signal: str = "signal") -> DataFrame:
    """(user, fold, y, pipeline, predicted, margin) of each epoch in its held-out fold; margin: best score less the second.

    A user's epochs go to one task, which fits all folds and pipelines; folds with fewer than two classes of two trials
    to learn from give no rows.
    """
    rows = epochs.select(user, F.col(fold).cast("int").alias("fold"), F.col(label).cast("bigint").alias("y"), F.col(signal).alias("x")).where("y IS NOT NULL")

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, f, y, out = stack(part["x"]), part["fold"].to_numpy(), part["y"].to_numpy(dtype=np.int64), []
        for held in np.unique(f):
            apart = f == held
            counts = np.unique(y[~apart], return_counts=True)[1]
            for p in pipelines if (counts >= 2).sum() >= 2 else ():
                classes, s = _scores(p, x[~apart], y[~apart], x[apart])
                ordered = np.sort(s, axis=1)
                out += zip([int(key[0])] * len(s), [int(held)] * len(s), y[apart], [p] * len(s), classes[s.argmax(axis=1)], ordered[:, -1] - ordered[:, -2])
        return pd.DataFrame(out, columns=[user, "fold", "y", "pipeline", "predicted", "margin"])

    return rows.groupBy(user).applyInPandas(fit, f"{user} bigint, fold int, y bigint, pipeline string, predicted bigint, margin double")


def purged_scores(epochs: DataFrame, user: str, fold: str, label: str, place: str, reach: int, pipeline: str, signal: str = "signal", least: int = 4) -> DataFrame:
    """(user, fold, purge, n, correct, purged, shared) of folds of overlapping windows, as they are and purged.

    Windows whose places (`place`: the number of a window in its stream) are less than `reach` apart share samples.
    With purge, training windows that share some with a held-out one are left out (purged); shared counts those that
    are still learned from. A user's windows go to one task, which fits all folds.
    """
    rows = epochs.select(user, F.col(fold).cast("int").alias("fold"), F.col(label).cast("bigint").alias("y"), F.col(place).cast("bigint").alias("at"), F.col(signal).alias("x")).where("y IS NOT NULL")

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, f, y, at = stack(part["x"]), part["fold"].to_numpy(), part["y"].to_numpy(dtype=np.int64), part["at"].to_numpy()
        out = []
        for held in np.unique(f):
            apart = f == held
            near = ~apart & (_distance(at, np.sort(at[apart])) < reach)
            for purge in (False, True):
                used = ~apart & ~near if purge else ~apart
                if used.sum() >= least and len(np.unique(y[used])) >= 2:
                    hits = int((PIPELINES[pipeline](x[used], y[used])(x[apart]) == y[apart]).sum())
                    out.append((int(key[0]), int(held), purge, int(apart.sum()), hits, int(near.sum()) if purge else 0, int((near & used).sum())))
        return pd.DataFrame(out, columns=[user, "fold", "purge", "n", "correct", "purged", "shared"])

    return rows.groupBy(user).applyInPandas(fit, f"{user} bigint, fold int, purge boolean, n bigint, correct bigint, purged bigint, shared bigint")


def _distance(places: np.ndarray, held: np.ndarray) -> np.ndarray:
    """How far each place is from the nearest of the held ones (sorted)."""
    right = np.searchsorted(held, places)
    left, right = held[np.maximum(right - 1, 0)], held[np.minimum(right, len(held) - 1)]
    return np.minimum(np.abs(places - left), np.abs(places - right))


def _csp_lda_hits(t: Trials, f: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hits, n) of each row of labels (rounds, trials; two classes) over all folds: csp_lda, fitted for all rounds side by side."""
    classes, (count, channels) = np.unique(labels), t.x.shape[:2]
    covs, x = t.covariances.reshape(count, -1), t.banded - t.banded.mean(axis=-1, keepdims=True)
    powers = (x @ x.transpose(0, 2, 1) / x.shape[-1]).reshape(count, -1)
    hits, n = np.zeros((2, len(labels)), dtype=np.int64)
    # What is held side by side stays within a few dozen MB.
    most = max(1, 1_000_000 // (4 * count))
    for start in range(0, len(labels), most):
        part = labels[start : start + most]
        for held in np.unique(f):
            apart = f == held
            member = np.stack([part[:, ~apart] == c for c in classes], axis=1).astype(np.float64)
            sizes = member.sum(axis=2)
            fits = np.flatnonzero((sizes > 0).all(axis=1))
            if not len(fits):
                continue
            member, sizes = member[fits], sizes[fits]
            mean = (member @ covs[~apart] / sizes[..., None]).reshape(len(fits), 2, channels, channels)
            w = K.csp(mean[:, 0], mean[:, 1])
            # A filtered signal's variance is a product of its filter with the trial's powers.
            v = np.maximum((w[..., :, None] * w[..., None, :]).reshape(len(fits), -1, channels * channels) @ powers.T, 1e-20)
            z = np.swapaxes(np.log(v / v.sum(axis=1, keepdims=True)), 1, 2)
            known = z[:, ~apart]
            means = member @ known / sizes[..., None]
            known = known - np.swapaxes(member, 1, 2) @ means
            squares = known**2
            model = Lda().of_moments(classes, sizes, means, np.swapaxes(known, 1, 2) @ known, np.swapaxes(squares, 1, 2) @ squares)
            hits[start + fits] += (model.predict(z[:, apart]) == part[fits][:, apart]).sum(axis=1)
            n[start + fits] += int(apart.sum())
    return hits, n


def permutation_scores(epochs: DataFrame, user: str, fold: str, label: str, order: str, pipeline: str, rounds: int, per_task: int = 250, signal: str = "signal") -> DataFrame:
    """(user, round, accuracy) of `rounds` cross-validations with shuffled labels, and of round 0 with the true ones.

    A task fits `per_task` rounds of one user, so epochs are sent once for those; csp_lda of two classes fits them side by
    side. Shuffles are seeded by user and round over the epochs in `order`; folds with fewer than two classes to learn
    from are left out.
    """
    rows = epochs.select(user, F.col(fold).alias("_f"), F.col(label).cast("bigint").alias("_y"), F.col(order).alias("_o"), F.col(signal).alias("_x")).where("_y is not null")
    sent = rows.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(rounds // per_task))))

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_o")
        t, f, true = Trials(stack(part["_x"])).made([pipeline]), part["_f"].to_numpy(), part["_y"].to_numpy(dtype=np.int64)
        numbers = range(int(key[1]) * per_task, min((int(key[1]) + 1) * per_task, rounds + 1))
        labels = np.stack([np.random.default_rng([int(key[0]), m]).permutation(true) if m else true for m in numbers])
        if pipeline == "csp_lda" and len(np.unique(true)) == 2:
            hits, n = _csp_lda_hits(t, f, labels)
        else:
            hits, n = np.zeros((2, len(labels)), dtype=np.int64)
            for held in np.unique(f):
                apart = f == held
                known, new = t[~apart], t[apart]
                for i, y in enumerate(labels):
                    if len(np.unique(y[~apart])) >= 2:
                        hits[i] += int((PIPELINES[pipeline](known, y[~apart])(new) == y[apart]).sum())
                        n[i] += int(apart.sum())
        out = [(int(key[0]), m, h / k) for m, h, k in zip(numbers, hits.tolist(), n.tolist()) if k]
        return pd.DataFrame(out, columns=[user, "round", "accuracy"])

    return dealt(sent, user, "_c").groupBy(user, "_c").applyInPandas(fit, f"{user} bigint, round int, accuracy double")


def balanced_folds(df: DataFrame, keys: list[str], group: str, folds: int) -> DataFrame:
    """(keys, group, fold): whole groups go to folds, the largest first, each to the lightest fold so far (ties: the first).

    Only counts of groups are gathered, one row of them a key; groups are recordings or people, few of a key.
    """
    counts = df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"))
    by_size = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("less"), F.col(group).alias("g")))).alias("_g"))
    empty = F.struct(F.array_repeat(F.lit(0).cast("bigint"), folds).alias("loads"), F.lit(-1).alias("fold"))

    def deal(state, one):
        last = F.element_at(state, -1)
        at = (F.array_position(last["loads"], F.array_min(last["loads"])) - 1).cast("int")
        loads = F.transform(last["loads"], lambda x, i: x - F.when(i == at, one["less"]).otherwise(F.lit(0).cast("bigint")))
        return F.concat(state, F.array(F.struct(loads.alias("loads"), at.alias("fold"))))

    dealt = by_size.withColumn("_d", F.aggregate("_g", F.array(empty), deal))
    rows = dealt.select(*keys, F.explode(F.arrays_zip(F.col("_g.g").alias("g"), F.slice(F.col("_d.fold"), 2, F.size("_g")).alias("fold"))).alias("z"))
    return rows.select(*keys, F.col("z.g").alias(group), F.col("z.fold").alias("fold"))


def complete_folds(df: DataFrame, keys: list[str], fold: str, label: str) -> DataFrame:
    """(keys, fold, trials, complete): whether a fold and the rest have all classes of their key."""
    c = df.groupBy(*keys, fold, label).agg(F.count(F.lit(1)).alias("_n"))
    every = c.groupBy(*keys, label).agg(F.sum("_n").alias("_all"))
    classes = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("_classes"))
    out = c.join(every, [*keys, label]).join(classes, keys).groupBy(*keys, fold)
    return out.agg(F.sum("_n").alias("trials"), ((F.count(F.lit(1)) == F.max("_classes")) & F.bool_and(F.col("_all") > F.col("_n"))).alias("complete"))


def held_out_csp_lda(epochs: DataFrame, fold: str, folds: int, label: str, out: str = "predicted", signal: str = "signal") -> DataFrame:
    """Adds what csp_lda predicts for each epoch, learned from all epochs of the other folds (two classes, 0 and 1).

    For training sets that are not small: covariances, means and moments are sums that merge across tasks, a set for
    each fold and class, and only those (a few hundred numbers a fold) reach the driver. Four passes, whatever the rows.
    A fold whose training set lacks a class predicts null.
    """
    rows = epochs.select(F.col(fold).alias("f"), F.col(label).alias("y"), F.col(signal).alias("x"))

    def sums(of: Callable[[np.ndarray, np.ndarray, np.ndarray], dict]) -> dict:
        """Sums by key of what `of` returns for batches of (folds, classes, signals)."""

        def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for b in batches:
                if len(b):
                    for k, v in of(b["f"].to_numpy(), b["y"].to_numpy(), banded(stack(b["x"]))).items():
                        held[k] = held.get(k, 0) + v
            for (f, y), v in held.items():
                yield pd.DataFrame({"f": f, "y": y, "p": range(len(v)), "v": v})

        found: dict = {}
        for r in rows.mapInPandas(within, "f int, y int, p int, v double").groupBy("f", "y", "p").agg(F.sum("v").alias("v")).orderBy("f", "y", "p").collect():
            found.setdefault((r["f"], r["y"]), []).append(r["v"])
        return {k: np.array(v) for k, v in found.items()}

    def covariance_sums(f: np.ndarray, y: np.ndarray, x: np.ndarray) -> dict:
        c = K.covariances(x).reshape(len(x), -1)
        return {(int(i), int(k)): np.append(c[at].sum(axis=0), at.sum()) for i in np.unique(f) for k in np.unique(y) if (at := (f == i) & (y == k)).any()}

    by = sums(covariance_sums)
    filters = {}
    for f in range(folds):
        total = [sum((v for (g, k), v in by.items() if g != f and k == y), np.zeros(1)) for y in (0, 1)]
        if all(t[-1] > 0 for t in total):
            n = int(len(total[0][:-1]) ** 0.5)
            filters[f] = K.csp(*[(t[:-1] / t[-1]).reshape(n, n) for t in total])

    def features(f: np.ndarray, y: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        for i, w in filters.items():
            for k in (0, 1):
                if (at := (f != i) & (y == k)).any():
                    yield i, k, K.log_variance_features(w, x[at])

    first = sums(lambda f, y, x: {(i, k): np.append(z.sum(axis=0), len(z)) for i, k, z in features(f, y, x)}) if filters else {}
    means = {k: v[:-1] / v[-1] for k, v in first.items()}

    def centred(f: np.ndarray, y: np.ndarray, x: np.ndarray) -> dict:
        out_: dict = {}
        for i, k, z in features(f, y, x):
            z = z - means[i, k]
            out_[i, k] = np.concatenate([(z.T @ z).ravel(), ((z**2).T @ (z**2)).ravel()])
        return out_

    second = sums(centred) if filters else {}
    models = {}
    for i, w in filters.items():
        d = len(w)
        moments = second[i, 0] + second[i, 1]
        models[i] = Lda().of_moments(np.array([0, 1]), np.array([first[i, k][-1] for k in (0, 1)]), np.stack([means[i, k] for k in (0, 1)]), moments[: d * d].reshape(d, d), moments[d * d :].reshape(d, d))

    @F.pandas_udf("int")
    def predicted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for f, x in batches:
            found = pd.Series([None] * len(f), dtype="Int32")
            for i, model in models.items():
                if (at := (f == i).to_numpy()).any():
                    found[at] = model.predict(K.log_variance_features(filters[i], banded(stack(x[at]))))
            yield found

    return epochs.withColumn(out, predicted(F.col(fold), F.col(signal)))
