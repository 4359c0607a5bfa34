"""Covariance geometry and spatial filters. Sums are distributed; matrices of channels x channels meet on the driver."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochflow.functions import kernels as K
from epochflow.operators.signals import SLICE, as_lists, batched, stack


def long_covariance(epochs: DataFrame, key: str, label: str, signal: str = "signal", shrink: float = 0.05) -> DataFrame:
    """(key, label, i, j, c): the trial covariances by expressions alone."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    # One mean a channel, bound by a transform of one element, and one power a trial.
    centred = F.transform(signal, lambda ch: F.transform(F.array(mean(ch)), lambda m: F.transform(ch, lambda v: v - m))[0])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    rows = epochs.select(key, label, centred.alias("x"), F.size(signal).alias("n"))
    rows = rows.withColumn("power", F.aggregate("x", F.lit(0.0), lambda s, ch: s + dot(ch, ch)))
    ij = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    c = dot(F.get("x", F.col("i")), F.get("x", F.col("j"))) / F.col("power")
    return ij.select(key, label, "i", "j", ((1 - shrink) * c + F.when(F.col("i") == F.col("j"), shrink / F.col("n")).otherwise(0.0)).alias("c"))


def class_means(covariances: DataFrame, label: str, column: str = "cov") -> dict:
    """Mean covariance of each class, as matrices; one row per class and entry reaches the driver."""
    rows = covariances.select(label, F.posexplode(column).alias("p", "c")).groupBy(label, "p").agg(F.avg("c").alias("c"))
    found: dict = {}
    for r in rows.collect():
        found.setdefault(r[label], {})[r["p"]] = r["c"]
    return {k: np.array([v[i] for i in range(len(v))]).reshape(int(len(v) ** 0.5), -1) for k, v in found.items()}


def frechet_mean(covariances: DataFrame, column: str = "cov", tolerance: float = 1e-8, rounds: int = 50) -> np.ndarray:
    """Riemannian mean: each step is one pass that adds up logarithms within tasks; the matrix alone goes to the driver.

    Steps end once one is shorter than the tolerance; a mean that `rounds` of them have not settled is warned of.
    """
    held = covariances.select(column).persist()
    try:
        # The first pass makes what is held, so that no task has workers for the covariances and for their logarithms at once.
        start = held.select(F.posexplode(column).alias("p", "c")).groupBy("p").agg(F.avg("c").alias("c")).orderBy("p").collect()
        n = int(len(start) ** 0.5)
        mean = np.array([r["c"] for r in start]).reshape(n, n)
        for _ in range(rounds):
            white = K.matrix_function(mean, lambda w: w**-0.5)

            def sums(batches: Iterator[pd.DataFrame], white: np.ndarray = white) -> Iterator[pd.DataFrame]:
                total, count = np.zeros((n, n)), 0
                for b in batches:
                    for start in range(0, len(b), SLICE):
                        c = np.stack(b[column].iloc[start : start + SLICE]).reshape(-1, n, n)
                        total += K.matrix_function(white @ c @ white, np.log).sum(axis=0)
                        count += len(c)
                yield pd.DataFrame({"p": range(n * n), "s": total.ravel(), "k": count})

            rows = held.mapInPandas(sums, "p int, s double, k bigint").groupBy("p").agg(F.sum("s").alias("s"), F.sum("k").alias("k")).orderBy("p").collect()
            step = np.array([r["s"] / max(r["k"], 1) for r in rows]).reshape(n, n)
            root = K.matrix_function(mean, np.sqrt)
            w, v = np.linalg.eigh(step)
            mean = root @ ((v * np.exp(w)) @ v.T) @ root
            if np.linalg.norm(step) < tolerance:
                break
        else:
            warnings.warn(f"the mean has not settled in {rounds} rounds: the last step was {np.linalg.norm(step):.1e}", stacklevel=2)
    finally:
        held.unpersist()
    return mean


def tangent_features(df: DataFrame, mean: np.ndarray, column: str = "cov", out: str = "features") -> DataFrame:
    n = len(mean)

    # Of batches, so that it runs in the worker of the function that makes the covariances.
    @F.pandas_udf("array<double>")
    def features(rows: pd.Series) -> pd.Series:
        parts = (rows.iloc[start : start + SLICE] for start in range(0, len(rows), SLICE))
        return pd.Series([v for part in parts for v in K.tangent(np.stack(part).reshape(-1, n, n), mean)], dtype=object)

    return df.withColumn(out, features(F.col(column)))


def csp_filters(epochs: DataFrame, label: str, classes: tuple, m: int = 4, column: str = "cov") -> np.ndarray:
    means = class_means(epochs.where(F.col(label).isin(*classes)), label, column)
    return K.csp(means[classes[0]], means[classes[1]], m)


def csp_features(df: DataFrame, filters: np.ndarray, signal: str = "signal", out: str = "features") -> DataFrame:
    return df.withColumn(out, batched(lambda x: as_lists(K.log_variance_features(filters, x)), "array<double>")(F.col(signal)))


def bank_csp_filters(epochs: DataFrame, label: str, classes: tuple, bands: tuple, m: int = 4, signal: str = "signal", fs: float = 250.0) -> list[np.ndarray]:
    """csp_filters() of each band of a filter bank: one pass sums the covariances of all bands within tasks."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            y = b[label].to_numpy()
            for start in range(0, len(b), SLICE):
                x, at = stack(b[signal].iloc[start : start + SLICE]), y[start : start + SLICE]
                for band, limits in enumerate(bands):
                    c = K.covariances(K.zero_phase(K.bandpass(4, *limits, fs), x)).reshape(len(x), -1)
                    for k in classes:
                        held[band, k] = held.get((band, k), 0) + np.append(c[at == k].sum(axis=0), (at == k).sum())
        for (band, k), v in held.items():
            yield pd.DataFrame({"band": band, "k": k, "p": range(len(v)), "v": v})

    rows = epochs.where(F.col(label).isin(*classes)).select(label, signal).mapInPandas(sums, "band int, k bigint, p int, v double")
    found: dict = {}
    for r in rows.groupBy("band", "k", "p").agg(F.sum("v").alias("v")).orderBy("band", "k", "p").collect():  # bands x classes x matrices
        found.setdefault((r["band"], r["k"]), []).append(r["v"])
    mean = {key: (np.array(v[:-1]) / v[-1]).reshape(int(len(v[:-1]) ** 0.5), -1) for key, v in found.items() if v[-1]}
    return [K.csp(mean[band, classes[0]], mean[band, classes[1]], m) for band in range(len(bands))]


def bank_csp_features(df: DataFrame, filters: list[np.ndarray], bands: tuple, signal: str = "signal", out: str = "features", fs: float = 250.0) -> DataFrame:
    """Adds the log-variance features of all bands side by side; no band's signals leave the function that makes them."""
    of = lambda x: np.concatenate([K.log_variance_features(w, K.zero_phase(K.bandpass(4, *limits, fs), x)) for w, limits in zip(filters, bands)], axis=1)
    return df.withColumn(out, batched(lambda x: as_lists(of(x)), "array<double>")(F.col(signal)))


def trca_filters(epochs: DataFrame, label: str, signal: str = "signal", bands: tuple | None = None, fs: float = 250.0, top: float = K.TOP_HZ) -> dict:
    """(filters, templates) of each class with two trials or more, a list of one of each a band; without bands a single pair.

    The sum of X_i X_j' over different trials is (sum X)(sum X)' - sum X X', so both are sums that merge across tasks;
    all bands are summed in one pass, under a key for band and class.
    """
    filters = [K.bandpass(4, low, min(top, 0.45 * fs), fs) for low in bands or ()]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for k, part in b.groupby(label):
                x = stack(part[signal])
                for band, y in enumerate([K.zero_phase(f, x) for f in filters] if bands else [x]):
                    y = y - y.mean(axis=-1, keepdims=True)
                    s, q, n = held.get((band, k), (0, 0, 0))
                    held[band, k] = s + y.sum(axis=0), q + (y @ y.transpose(0, 2, 1)).sum(axis=0), n + len(y)
        for (band, k), (s, q, n) in held.items():
            values = np.concatenate([s.ravel(), q.ravel()])
            yield pd.DataFrame({"band": band, "k": k, "p": range(len(values)), "v": values, "n": n, "c": len(q)})

    rows = epochs.select(label, signal).mapInPandas(sums, "band int, k bigint, p int, v double, n bigint, c int")
    rows = rows.groupBy("band", "k", "p").agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.max("c").alias("c")).orderBy("k", "band", "p").toPandas()  # bands x classes x (channels x samples)
    out: dict = {}
    for (k, _), mine in rows.groupby(["k", "band"], sort=True):
        n, c, values = int(mine["n"].iloc[0]), int(mine["c"].iloc[0]), mine["v"].to_numpy()
        s, q = values[: -c * c].reshape(c, -1), values[-c * c :].reshape(c, c)
        if n >= 2:
            out.setdefault(int(k), []).append((K.trca(s @ s.T - q, q), s / n))
    return {k: ([f for f, _ in found], [t for _, t in found]) if bands else found[0] for k, found in out.items()}


def trca_scores(df: DataFrame, filters: dict, signal: str = "signal", out: str = "scores", bands: tuple | None = None, weights: tuple = K.BAND_WEIGHTS, fs: float = 250.0) -> DataFrame:
    """Signed squared correlations with each class template, through all filters together; over bands, their weighted sum."""
    if bands:
        w, templates = (np.array([np.array(found[i]) for found in filters.values()]).swapaxes(0, 1) for i in (0, 1))
        return df.withColumn(out, batched(lambda x: as_lists(K.filter_bank_trca_scores(x, w, templates, fs, bands, weights)), "array<double>")(F.col(signal)))
    w = np.stack([f for f, _ in filters.values()])
    templates = [(w @ t).ravel() for _, t in filters.values()]

    def kernel(x: np.ndarray) -> list:
        x = x - x.mean(axis=-1, keepdims=True)
        found = [[K.pearson((w @ t).ravel(), one) for one in templates] for t in x]
        return [[np.sign(r) * r * r for r in row] for row in found]

    return df.withColumn(out, batched(kernel, "array<double>")(F.col(signal)))
