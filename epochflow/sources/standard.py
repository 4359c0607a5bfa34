"""Standardised archives of public recordings: fifteen rules, checked in the pass that writes them.

Trials are written to a folder of their own, each with what it breaks beside it; only if that one small column of the
written trials is empty is the folder published, by a manifest that names it. A reader goes by the manifest, so it never sees an archive that broke
a rule or is half written, and checks again what the rows must say.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochflow.functions import dims

#: Version of this layout; other versions are refused.
SCHEMA_VERSION = 1
ROWS = "epoch_id string, subject string, session string, label string, source_label string, signal array<array<double>>"
_MANIFEST = "manifest string"


@dataclass(frozen=True)
class Header:
    """What holds for all trials of an archive. mapping: (source label, label) pairs that the data set declares."""

    dataset: str
    category: str
    channels: tuple[str, ...]
    samples: int
    fs: float
    units: str
    paradigm: str
    mapping: tuple[tuple[str, str], ...]


def category_of(label: Column) -> Column:
    """The category of a canonical label; null for idle and for labels that no category has."""
    return F.coalesce(*[F.when(label.isin(*names), F.lit(c)) for c, names in dims.INTENTS.items() if c != dims.IDLE])


def header_rules(h: Header) -> dict[str, bool]:
    """Rules of the archive as a whole, and whether each is broken."""
    known = {d[0]: d[1] for d in dims.DATASETS}
    return {
        "channel labels repeat or are missing": not h.channels or len(set(h.channels)) != len(h.channels),
        "fs is not positive": not h.fs > 0,
        "units are not stated": not h.units.strip(),
        "paradigm is neither imagery nor execution": h.paradigm not in ("imagery", "execution"),
        "data set is not in the registry": h.dataset not in known,
        "registry does not provide the category": h.category not in known.get(h.dataset, ()),
    }


def trial_rules(h: Header) -> dict[str, Column]:
    """Rules of single trials, as conditions that broken ones meet."""
    pair = [(F.col("source_label") == s) & (F.col("label") == t) for s, t in h.mapping]
    number = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return {
        "signal is not channels x samples": ~((F.size("signal") == len(h.channels)) & F.forall("signal", lambda c: F.size(c) == h.samples)),
        "signal is not finite": ~F.forall("signal", lambda c: F.forall(c, number)),
        "subject is missing": F.col("subject").isNull(),
        "session is missing": F.col("session").isNull(),
        "label is missing": F.col("label").isNull() | F.col("source_label").isNull(),
        "label is not canonical": (F.col("label") != dims.IDLE) & category_of(F.col("label")).isNull(),
        "label is of another category": F.coalesce(category_of(F.col("label")) != h.category, F.lit(False)),
        "labels are not a pair of the registry's mapping": ~reduce(lambda a, b: a | b, pair, F.lit(False)),
    }


def rule_counts(df: DataFrame, h: Header) -> DataFrame:
    """(rule, trials): how many trials break each rule; one scan, a row a rule."""
    rules = trial_rules(h)
    sums = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(f"r{i}") for i, c in enumerate(rules.values())])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("trials")) for i, n in enumerate(rules)])).alias("x")).select("x.*")


def write_archive(df: DataFrame, h: Header, path: str) -> None:
    """Writes trials (ROWS) by subject and publishes them; raises with the rules that are broken, and publishes nothing then.

    The rows are read once: the rules that a trial breaks are written as bits beside it, and counted from what was
    written (a task that ran twice counts once). An archive without trials breaks a rule.
    """
    broken = [name for name, bad in header_rules(h).items() if bad]
    if broken:
        raise ValueError("; ".join(broken))
    rules = trial_rules(h)
    bits = reduce(lambda a, b: a + b, [F.when(F.coalesce(c, F.lit(True)), 1 << i).otherwise(0) for i, c in enumerate(rules.values())])
    part = f"trials-{uuid.uuid4().hex}"
    rows = df.select(*[F.col(c).cast(t) for c, t in (x.split(" ", 1) for x in ROWS.split(", "))])
    rows.withColumn("broken", bits.cast("int")).write.partitionBy("subject").parquet(f"{path}/{part}")
    counts = [F.count_if(F.col("broken").bitwiseAND(F.lit(1 << i)) != 0).alias(f"r{i}") for i in range(len(rules))]
    found = df.sparkSession.read.schema(f"{ROWS}, broken int").parquet(f"{path}/{part}").agg(F.count(F.lit(1)).alias("n"), *counts).first()
    broken = [f"{name} ({found[f'r{i}']} trials)" for i, name in enumerate(rules) if found[f"r{i}"]] + ([] if found["n"] else ["no trials"])
    if broken:
        raise ValueError("; ".join(broken))
    manifest = json.dumps({"schema_version": SCHEMA_VERSION, "folder": part, "trials": found["n"], **asdict(h)}, sort_keys=True)
    df.sparkSession.createDataFrame([(manifest,)], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").first()[0])


def _header(m: dict) -> Header:
    return Header(m["dataset"], m["category"], tuple(m["channels"]), m["samples"], m["fs"], m["units"], m["paradigm"], tuple(map(tuple, m["mapping"])))


def read_archive(spark: SparkSession, path: str, imagery_only: bool = True) -> DataFrame:
    """The published trials (ROWS and dataset, category, fs, units); raises on another version or paradigm.

    Rows that do not keep the rules any more raise when they are read.
    """
    m = manifest(spark, path)
    if m["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"{path} has schema version {m['schema_version']}")
    h = _header(m)
    if imagery_only and h.paradigm != "imagery":
        raise ValueError(f"{path} holds {h.paradigm}, not imagery")
    df = spark.read.schema(ROWS).parquet(f"{path}/{m['folder']}")
    broken = reduce(lambda a, x: a.when(F.coalesce(x[1], F.lit(True)), F.lit(x[0])), trial_rules(h).items(), F.when(F.lit(False), ""))
    checked = df.withColumn("label", F.when(broken.isNull(), F.col("label")).otherwise(F.raise_error(F.concat(F.lit(f"{path}: "), broken))))
    return checked.withColumns({"dataset": F.lit(h.dataset), "category": F.lit(h.category), "fs": F.lit(h.fs), "units": F.lit(h.units)})


def union_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The trials of archives that agree in category, rate, units, paradigm, channels in order, and samples; else it raises.

    Subjects become dataset:subject, sessions dataset:subject:session.
    """
    if not paths:
        raise ValueError("at least one archive is needed")
    heads = [_header(manifest(spark, p)) for p in paths]
    for h, p in zip(heads[1:], paths[1:]):
        for name in ("category", "fs", "units", "paradigm", "channels", "samples"):
            if getattr(h, name) != getattr(heads[0], name):
                raise ValueError(f"{p} has another {name}: {getattr(h, name)!r}, not {getattr(heads[0], name)!r}")
    tagged = lambda df: df.withColumns({"session": F.concat_ws(":", "dataset", "subject", "session"), "subject": F.concat_ws(":", "dataset", "subject")})
    return reduce(DataFrame.unionByName, [tagged(read_archive(spark, p)) for p in paths])
