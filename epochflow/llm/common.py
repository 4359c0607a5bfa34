"""What several operators of this subpackage share: scratch tables, word rules, cells, components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Translation table for bytes: A-Z become a-z, everything else stays.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and cuts at \\x20 and \\x09-\\x0D, which is what bytes.split() takes as white space."""
    return (text or "").encode("utf-8", "replace").translate(ASCII_LOWER).split()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one is set only where the session names none and is local, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it again: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/epochflow-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder_is(id_col: str, modulus: int, remainder: int):
    """crc32 of the id as text, modulo; a null id never matches."""
    hashed = F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
    return F.coalesce(hashed == remainder, F.lit(False))


def few(df: DataFrame, rows: int = 300_000) -> bool:
    """Whether df has at most that many rows, so that it may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def perhaps_broadcast(df: DataFrame) -> DataFrame:
    """df, to be broadcast where it is small; it should be a written table."""
    return F.broadcast(df) if few(df) else df


def heavy_keys(df: DataFrame, keys: list[str], most: float, weight: Column | None = None) -> DataFrame:
    """(keys, _tiles) of the keys that weigh more than `most`: at most rows / most of them."""
    total = F.sum(weight if weight is not None else F.lit(1))
    return written(df.groupBy(*keys).agg(total.alias("_w")).where(F.col("_w") > most).select(*keys, F.ceil(F.col("_w") / most).cast("int").alias("_tiles")), "heavy")


def tiled(df: DataFrame, keys: list[str], spread: str, most: float, weight: Column | None = None) -> DataFrame:
    """Adds tile_a <= tile_b so that groups of (keys, tile_a, tile_b) hold about 2 * most rows (or weight) at the most.

    A key with n rows is cut into ceil(n / most) tiles by a hash of `spread`; a row goes to each pair of tiles that
    holds its own (column `tile`), so every two rows of a key meet in exactly one group (two rows of one tile meet in
    the group where tile_a = tile_b). Keys that fit keep one tile and one copy of each row. Rows learn of heavy keys by
    a broadcast of those (by a join if there are too many), so a heavy key is split before any shuffle.
    """
    out = df.join(perhaps_broadcast(heavy_keys(df, keys, most, weight)), keys, "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    out = out.withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), F.col(spread)), F.col("_tiles")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return out.withColumn("tile_a", F.least("tile", "_other")).withColumn("tile_b", F.greatest("tile", "_other")).drop("_tiles", "_other")


def packed(df: DataFrame, keys: list[str], spread: str, most: float, weight: Column | None = None) -> DataFrame:
    """tiled(), and a bucket: small keys share buckets of about `most` rows (or weight), heavy ones have their own.

    Groups of (bucket, tile_a, tile_b) hold about 2 * most at the most; a group may hold several keys.
    """
    total = df.agg(F.sum(weight if weight is not None else F.lit(1))).first()[0] or 0
    out = tiled(df, keys, spread, most, weight)
    hashed = F.xxhash64(F.lit("bucket"), *keys)
    alone = F.col("tile_b") > 0  # every copy of a row of a heavy key but that of its first tile with itself
    return out.withColumn("bucket", F.when(alone, hashed).otherwise(F.pmod(hashed, F.lit(max(1, math.ceil(total / most))))))


def joined(rows: DataFrame, classes: DataFrame, key: str, size: str, most: int = 100_000) -> DataFrame:
    """rows left-joined with classes (unique keys; `size`: rows of the class, dropped) by key, whatever rows share a key.

    Classes of more than `most` rows, of which there are at most rows / most, are broadcast; null keys meet nothing.
    """
    big = written(classes.where(F.col(size) > most), "big_classes").drop(size)
    keyed, none = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    out = keyed.join(F.broadcast(big), key)
    out = out.unionByName(keyed.join(F.broadcast(big.select(key)), key, "left_anti").join(classes.where(F.col(size) <= most).drop(size), key, "left"))
    return out.unionByName(none, allowMissingColumns=True)


def merge_roots(root: np.ndarray, members: np.ndarray) -> None:
    """Joins the sets of all members; each set is named by its smallest index."""
    found = np.unique(root[members])
    if len(found) > 1:
        root[np.isin(root, found[1:])] = found[0]


def runs(keys: np.ndarray, tile: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key and tile: the rows low to high (exclusive) that each row is to be compared with."""
    at = np.arange(len(keys))
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else at
    ends = np.append(starts[1:], len(keys))
    run = np.repeat(np.arange(len(starts)), ends - starts)
    if a == b:
        return at + 1, ends[run]
    second = np.add.reduceat((tile == a).astype(np.int64), starts) + starts if len(keys) else at
    return np.where(tile == a, second[run], at), np.where(tile == a, ends[run], at)


def least_linked(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each row reaches by the pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            low = np.minimum(root[i], root[j])
            if (root[i] == low).all() and (root[j] == low).all():
                break
            for x in (i, j):
                np.minimum.at(root, root[x], low)
                np.minimum.at(root, x, low)
            root = root[root]
    while (root[root] != root).any():
        root = root[root]
    return root


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Labels each node of the undirected edges (a, b: bigint) with the smallest node it reaches.

    Alternates large-star and small-star steps until the edges no longer change; every round is a few aggregations and
    joins over edges only, written to the shared folder. Returns (node, component) for nodes that reach a smaller one
    (so not for the component itself); an empty input gives an empty result. Null ends and loops are left out.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m"))
    e = written(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("v") != F.col("m"))).distinct(), "edges")
    before = state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.union(e.select("m", "v")).toDF("u", "n")
        lowest = both.groupBy("u").agg(F.least(F.min("n"), F.col("u")).alias("m"))
        large = both.where("n > u").join(lowest, "u").select(F.col("n").alias("v"), "m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("x"))
        e = written(small.select("x.v", "x.m").where("v != m").distinct(), "edges")
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("m").alias("component"))


def bits_for(rows: int, cell_rows: int) -> int:
    """Key bits that bring the mean cell of evenly spread keys down to cell_rows."""
    return max(0, math.ceil(math.log2(max(rows, 1) / cell_rows)))
