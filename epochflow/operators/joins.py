"""Joins by time and by set: interval, as-of, nearest, positional, division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_epochs(samples: DataFrame, cues: DataFrame, keys: list[str], size: int, offset: int = 0, index: str = "i", value: str = "x", start: str = "start") -> DataFrame:
    """One row per cue with the samples [start + offset, start + offset + size) in order; incomplete cues are left out.

    An equi-join on buckets of `size` samples, as an interval touches two of them at most; so no range join over all
    pairs is needed.
    """
    first = F.col(start) + offset
    wide = cues.withColumn("_first", first).withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor(first / size), F.floor((first + size - 1) / size)))))
    fine = samples.select(*keys, F.col(index).alias("_i"), F.col(value).alias("_x"), F.floor(F.col(index) / size).alias("_bucket"))
    hits = wide.join(fine, [*keys, "_bucket"]).where((F.col("_i") >= F.col("_first")) & (F.col("_i") < F.col("_first") + size))
    out = hits.groupBy(*cues.columns).agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_s"))
    return out.where(F.size("_s") == size).select(*cues.columns, F.transform("_s", lambda s: s["_x"]).alias("signal"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str]) -> DataFrame:
    """left with the payload of the latest right row of its key at or before its time (null if none).

    A union and one running window, so each side is shuffled once and nothing is paired. Of right rows of one time the
    one with the largest payload counts.
    """
    right = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(F.max(F.struct(*payload)).alias("_p")).withColumn("_side", F.lit(0))
    both = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_p.{c}").alias(c) for c in payload])


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def both_ends(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first and the last k rows of each key, once each, by an order that tells rows apart.

    Each end is a limit by rank, which tasks apply to their own rows before anything is shuffled.
    """
    ends = [df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c in order]))).where(F.col("_r") <= k).drop("_r") for up in (True, False)]
    return ends[0].union(ends[1]).dropDuplicates([*keys, *order])


def nearest_within(wanted: DataFrame, table: DataFrame, want: str, have: str, tolerance: float) -> DataFrame:
    """wanted with the nearest table value within the tolerance (ties to the smaller), null if none.

    Both sides are bucketed by the tolerance, so only neighbouring buckets meet.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    near = table.select(F.col(have).alias("_h"), F.explode(F.array(cell(have) - 1, cell(have), cell(have) + 1)).alias("_c"))
    found = wanted.select(want).distinct().withColumn("_c", cell(want)).join(near, "_c").where(F.abs(F.col("_h") - F.col(want)) <= tolerance)
    best = found.groupBy(want).agg(F.min(F.struct(F.abs(F.col("_h") - F.col(want)).alias("d"), F.col("_h"))).alias("_b"))
    return wanted.join(best, want, "left").select(*wanted.columns, F.col("_b._h").alias(have))


def positional(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Pairs the n-th rows of both sides of each key; keys whose sides differ in number are left out."""
    number = lambda d, o: d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(o))).withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return number(left, left_order).join(number(right, right_order), [*keys, "_n", "_of"]).drop("_n", "_of")


def having_all(df: DataFrame, key: str, item: str, wanted: list) -> DataFrame:
    """The rows of keys that have every wanted item (relational division)."""
    full = df.where(F.col(item).isin(wanted)).groupBy(key).agg(F.count_distinct(item).alias("_n")).where(F.col("_n") == len(wanted))
    return df.join(full.select(key), key, "left_semi")


def stated_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column whether all rows agree on it (nulls aside)."""
    return df.agg(*[(F.count_distinct(c) <= 1).alias(c) for c in columns])


def union_tagged(frames: dict[str, DataFrame], ids: list[str]) -> DataFrame:
    """A union of frames with the same columns; ids are prefixed with the frame's name, which becomes `source`."""
    out = None
    for name, df in frames.items():
        one = df.withColumns({c: F.concat_ws(":", F.lit(name), F.col(c).cast("string")) for c in ids}).withColumn("source", F.lit(name))
        if out is not None and set(one.columns) != set(out.columns):
            raise ValueError(f"{name} has other columns")
        out = one if out is None else out.unionByName(one)
    return out


def prefer(candidates: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The candidate of the lowest rank of each key."""
    return first_per(candidates, keys, rank)
