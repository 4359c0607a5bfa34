"""Epoch archives and recordings: explicit schemas, row rules, partitioned tables."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochflow.operators.information import running_count
from epochflow.operators.stats import exact_quantile
from epochflow.operators.windows import chunked

EPOCH_SCHEMA = "epoch_id string, subject string, session string, label string, fs double, montage string, units string, signal array<array<double>>"
# Schema version of archives, and accepted units with their factor to microvolts.
VERSION, MICROVOLTS = 1, {"uV": 1.0, "mV": 1e3, "V": 1e6}


def epoch_rules(df: DataFrame, signal: str, size: int, label: str) -> DataFrame:
    """Adds shape_ok, finite_ok and label_ok."""
    finite = F.forall(signal, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.withColumns({"shape_ok": F.size(signal) == size, "finite_ok": F.coalesce(finite, F.lit(False)), "label_ok": F.col(label).isNotNull()})


def check_archive(df: DataFrame) -> DataFrame:
    """One row per broken rule with the rows that break it; an archive without any may be written."""
    channels, samples = F.size("signal"), F.size(F.get("signal", F.lit(0)))
    rules: dict[str, Column] = {
        "signal is missing": F.col("signal").isNull(),
        "channels differ in length": F.exists("signal", lambda c: F.size(c) != samples),
        "signal is not finite": F.exists("signal", lambda c: F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))),
        "no channels": channels < 1,
        "fs is not positive": ~(F.col("fs") > 0),
        "units are unknown": ~F.col("units").isin(*MICROVOLTS),
        "label is missing": F.col("label").isNull(),
        "subject is missing": F.col("subject").isNull(),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def write_archive(df: DataFrame, path: str) -> None:
    """Writes a checked archive by subject and session; raises and writes nothing if a rule is broken."""
    if found := check_archive(df).collect():  # at most one row a rule
        raise ValueError("; ".join(f"{r['rule']} ({r['rows']} rows)" for r in found))
    df.withColumn("schema_version", F.lit(VERSION)).write.partitionBy("subject", "session").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive, in microvolts; raises at run time on another schema version."""
    df = spark.read.schema(f"{EPOCH_SCHEMA}, schema_version int").parquet(path)
    held = F.when(F.col("schema_version") == VERSION, F.col("units")).otherwise(F.raise_error("another schema version"))
    factor = F.coalesce(*[F.when(held == u, F.lit(k)) for u, k in MICROVOLTS.items()])
    return df.withColumn("signal", F.transform("signal", lambda c: F.transform(c, lambda x: x * factor))).withColumn("units", F.lit("uV")).drop("schema_version")


def read_npz(spark: SparkSession, pattern: str) -> DataFrame:
    """Recordings in NumPy archives (X, labels, fs, montage, subject), a row per trial; one file is one task's work."""

    def rows(batches):
        for files in batches:
            for path, body in zip(files["path"], files["content"]):
                z = np.load(io.BytesIO(body), allow_pickle=False)
                x, name = z["X"].astype(np.float64), path.rsplit("/", 1)[-1].removesuffix(".npz")
                said = {k: str(z[k]) if k in z else "" for k in ("subject", "montage")}
                yield pd.DataFrame(
                    {
                        "epoch_id": [f"{name}:{i}" for i in range(len(x))],
                        "subject": said["subject"],
                        "session": name,
                        "label": [str(v) for v in z["labels"]],
                        "fs": float(z["fs"]),
                        "montage": said["montage"],
                        "units": "uV",
                        "signal": [list(map(list, t)) for t in x],
                    }
                )

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(rows, EPOCH_SCHEMA)


def sniffed_separator(spark: SparkSession, path: str, among: str = ",;\t") -> str:
    """The separator that the header line (one line reaches the driver) has most of; the first where it has none."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError("no header row")
    return max(among, key=lambda c: (header[0].count(c), -among.index(c)))


def read_continuous_csv(spark: SparkSession, path: str, time: str, channels: list[str], separator: str | None = None, scale: float = 1.0, unit: str = "auto", least: int = 10, nominal: float = 250.0) -> DataFrame:
    """(i, channel, x, fs) of a table of samples: names are matched in any case, rows with a non-number are dropped.

    fs is inferred from the median of the positive time steps: in seconds (`s`) or milliseconds (`ms`), or as either (`auto`),
    whichever gives a rate of 20 to 5000 Hz, the one closer to `nominal` if both do. Without such a rate, or with fewer than
    `least` rows of numbers, reading raises. Samples are numbered by ranges of time (ties: as they lie in the
    files), so a recording of any length is no one task's work.
    """
    raw = spark.read.option("header", True).option("sep", separator or sniffed_separator(spark, path)).csv(path)
    name = {c.strip().lower(): c for c in raw.columns}
    if missing := [c for c in (time, *channels) if c.strip().lower() not in name]:
        raise ValueError(f"columns {missing} are missing; found {raw.columns}")
    col = lambda c: F.expr(f"try_cast(`{name[c.strip().lower()]}` as double)")
    rows = raw.select(col(time).alias("t"), *[(col(c) * scale).alias(c) for c in channels]).dropna()
    placed = running_count(rows.withColumn("_id", F.monotonically_increasing_id()), [], ["t", "_id"], F.lit(1), "i").withColumn("i", F.col("i") - 1).drop("_id")
    dt = F.col("t") - F.lag("t").over(Window.partitionBy("chunk").orderBy("i"))
    steps = chunked(placed, "i", 65_536, before=1).withColumn("dt", dt).where("own AND dt > 0 AND dt < double('infinity')")
    step = exact_quantile(steps, [], "dt", [0.5]).select(F.col("quantiles")[0].alias("step"))
    n, dt = placed.agg(F.count(F.lit(1))).first()[0], step.first()
    if n < least:
        raise ValueError(f"{n} rows of numbers, fewer than {least}")
    if dt is None:
        raise ValueError("time does not advance")
    rates = [k / dt["step"] for u, k in (("s", 1.0), ("ms", 1000.0)) if unit in (u, "auto")]
    if not (plausible := [r for r in rates if unit != "auto" or 20 <= r <= 5000]):
        raise ValueError(f"no plausible rate from steps of {dt['step']}; name the unit of time")
    fs = min(plausible, key=lambda r: abs(r - nominal))
    return placed.select("i", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in channels])).alias("s")).select("i", "s.*", F.lit(fs).alias("fs"))
