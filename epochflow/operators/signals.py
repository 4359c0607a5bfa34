"""Signal operators on DataFrames: numpy kernels over Arrow batches of rows with a signal array<array<double>>."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochflow.functions import kernels as K


#: Trials that a kernel takes at once, so that its arrays stay small whatever a batch holds.
SLICE = 1_000


def stack(rows: pd.Series) -> np.ndarray:
    """(rows, channels, samples)."""
    return np.stack([np.stack(r) for r in rows]).astype(np.float64)


def batched(kernel: Callable[[np.ndarray], object], returns: str):
    """A pandas UDF of a kernel that takes (rows, channels, samples); trials of one batch have one shape each.

    It takes a batch, not an iterator of them: Spark runs such functions of one another in one Python worker, and others
    in a worker each.
    """

    @F.pandas_udf(returns)
    def udf(rows: pd.Series) -> pd.Series:
        out: list = [None] * len(rows)
        shapes: dict = {}
        for i, r in enumerate(rows):
            if r is not None and len(r):
                shapes.setdefault((len(r), len(r[0])), []).append(i)
        for at in shapes.values():
            for part in (at[start : start + SLICE] for start in range(0, len(at), SLICE)):
                for i, value in zip(part, kernel(stack(rows.iloc[part]))):
                    out[i] = value
        if returns.startswith("struct"):
            return pd.DataFrame([v or {} for v in out], columns=[f.split(":")[0] for f in returns[7:-1].split(",")])
        return pd.Series(out, dtype=object if "array" in returns or returns == "string" else None)

    return udf


def as_lists(x: np.ndarray) -> list:
    """Rows as arrays: a number in a list of its own takes four times its bytes."""
    return list(x)


def bandpassed(signal: Column, fs: float, low: float, high: float, order: int = 4) -> Column:
    sos = K.bandpass(order, low, high, fs)
    return batched(lambda x: [list(map(list, t)) for t in K.zero_phase(sos, x)], "array<array<double>>")(signal)


def fbcca_scores(signal: Column, frequencies: list[float], fs: float, channels: list[int], **bank) -> Column:
    return batched(lambda x: as_lists(K.fbcca(x, frequencies, fs, channels, **bank)), "array<double>")(signal)


def cca_scores(signal: Column, frequencies: list[float], fs: float, channels: list[int], harmonics: int = 4) -> Column:
    return batched(lambda x: as_lists(K.cca(x, frequencies, fs, channels, harmonics)), "array<double>")(signal)


def notched(signal: Column, fs: float, frequency: float = 50.0, quality: float = 30.0) -> Column:
    sos = K.notch(frequency, quality, fs)
    return batched(lambda x: [list(map(list, t)) for t in K.zero_phase(sos, x)], "array<array<double>>")(signal)


def shapes(signal: Column, fs: float, fundamental: float) -> Column:
    """sine, square or noise of each channel, with the third harmonic's share of the first."""
    of = lambda x: [[dict(zip(("shape", "ratio"), K.shape_of(c, fs, fundamental))) for c in t] for t in x]
    return batched(of, "array<struct<shape:string,ratio:double>>")(signal)


def gated_spectrum(long: DataFrame, keys: list[str], index: str, value: str, n: int, floor: float) -> DataFrame:
    """(keys, index, y): short signals of n samples without the frequency bins whose amplitude is below the floor (no UDF)."""
    bins = spectrum(long, keys, index, value, n, 1.0, parts=True).where(F.col("amplitude") >= floor)
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(index)
    rows = bins.select(*keys, "bin", "re", "im", at)
    angle = 2 * np.pi * F.pmod(F.col("bin") * F.col(index), F.lit(n)) / n
    share = F.when((F.col("bin") == 0) | (F.col("bin") * 2 == n), 1.0).otherwise(2.0) / n
    kept = rows.groupBy(*keys, index).agg(F.sum(share * (F.col("re") * F.cos(angle) + F.col("im") * F.sin(angle))).alias("y"))
    return long.select(*keys, index).join(kept, [*keys, index], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def blink(signal: Column, fs: float, channels: list[int], limit: float = 100.0) -> Column:
    """Judged on the raw signal; after a high-pass blinks are gone."""
    return batched(lambda x: K.is_blink(x[:, channels], fs, limit).tolist(), "boolean")(signal)


def covariance(signal: Column, shrink: float = 0.05) -> Column:
    """Row-major covariance matrices."""
    return batched(lambda x: as_lists(K.covariances(x, shrink).reshape(len(x), -1)), "array<double>")(signal)


def band_powers(signal: Column, fs: float, band: tuple[float, float], segment: int = 256) -> Column:
    return batched(lambda x: as_lists(K.band_power(x, fs, band, segment)), "array<double>")(signal)


def band_integrals(signal: Column, fs: float, bands: dict[str, tuple[float, float]], segment: int = 256) -> Column:
    """Of each channel a map from band to its integrated power; bands with fewer than two bins are not in it."""

    def of(x: np.ndarray) -> list:
        return [[{b: float(v) for b, v in zip(bands, c) if v == v} for c in t] for t in K.band_integral(x, fs, bands.values(), segment)]

    return batched(of, "array<map<string,double>>")(signal)


def tones(df: DataFrame, fs: float, signal: str = "signal", low: float = 4.0, high: float = 45.0) -> DataFrame:
    """Adds the dominant tone of the best channel: tone_channel, frequency, amplitude, snr."""

    def best(x: np.ndarray) -> list:
        out = []
        for trial in x:
            found = [K.tone(c, fs, low, high) for c in trial]
            k = int(np.argmax([t["snr"] for t in found]))
            out.append({"tone_channel": k, **found[k]})
        return out

    udf = batched(best, "struct<tone_channel:int,frequency:double,amplitude:double,snr:double>")

    return df.withColumn("_t", udf(F.col(signal))).select(*df.columns, "_t.*")


def spectrum(long: DataFrame, keys: list[str], index: str, value: str, n: int, fs: float, parts: bool = False) -> DataFrame:
    """Amplitudes of every frequency bin of short signals of n samples, as sums of products (no UDF)."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("bin")
    rows = long.select(*keys, F.col(index).alias("_i"), F.col(value).alias("_x"), bins)
    angle = 2 * np.pi * F.pmod(F.col("bin") * F.col("_i"), F.lit(n)) / n
    out = rows.groupBy(*keys, "bin").agg(F.sum(F.col("_x") * F.cos(angle)).alias("re"), F.sum(F.col("_x") * F.sin(angle)).alias("im"))
    scale = F.when((F.col("bin") == 0) | (F.col("bin") * 2 == n), 1.0).otherwise(2.0) / n
    return out.select(*keys, "bin", *(["re", "im"] if parts else []), (F.col("bin") * fs / n).alias("hz"), (scale * F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)).alias("amplitude"))


def tone_command(hz: Column, snr: Column, commands: list[tuple[float, str]], tolerance: float, least_snr: float = 0.0) -> list[Column]:
    """command and confidence of a tone: the nearest of a few frequencies (ties: the lower) within the tolerance.

    No command, and confidence 0, without one or for a tone weaker than least_snr; else min(1, snr / 20).
    """
    near = F.array_min(F.filter(F.array(*[F.struct(F.abs(hz - f).alias("d"), F.lit(f).alias("hz"), F.lit(c).alias("command")) for f, c in commands]), lambda x: x["d"] <= tolerance))
    command = F.when(snr >= least_snr, near["command"])
    return [command.alias("command"), F.when(command.isNotNull(), F.least(F.lit(1.0), snr / 20)).otherwise(0.0).alias("confidence")]


def band_table(bins: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]]) -> DataFrame:
    """(the last key, band, median_power, n): summed squared amplitudes of spectrum()'s bins within each band, medians over the other keys.

    Bands are a few and fixed; bands without a bin have no row. Medians are exact, from bracketed quantiles.
    """
    from epochflow.operators.stats import exact_quantile

    named = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for b, (low, high) in bands.items()])
    rows = bins.select(*keys, "hz", "amplitude", F.explode(F.filter(named, lambda b: F.col("hz").between(b["low"], b["high"]))).alias("b"))
    power = rows.groupBy(*keys, F.col("b.band").alias("band")).agg(F.sum(F.col("amplitude") ** 2).alias("power"))
    n = power.groupBy(keys[-1], "band").agg(F.count(F.lit(1)).alias("n"))
    return exact_quantile(power, [keys[-1], "band"], "power", [0.5]).select(keys[-1], "band", F.col("quantiles")[0].alias("median_power")).join(n, [keys[-1], "band"])
