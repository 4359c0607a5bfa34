"""Vectors: near-duplicates by randomised-rotation binary codes, nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bits_for, connected_components, joined, least_linked, packed, perhaps_broadcast, runs, written


def usable(column: str):
    """Whether a vector has components, all of them finite, and not all zero."""
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(F.col(column), lambda x: x != 0), F.lit(False))


def rotation(size: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no norm overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; vectors too large or small for plain norms are scaled first."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    with np.errstate(all="ignore"):
        out = (x * y).sum(axis=1) / (nx * ny)
    odd = ~np.isfinite(out) | (nx < 1e-100) | (ny < 1e-100)
    if odd.any():
        out[odd] = (_unit(x[odd]) * _unit(y[odd])).sum(axis=1)
    return out


@lru_cache(maxsize=8)
def stacked(size: int, seed: int, bits: int = 256) -> np.ndarray:
    """Random rotations side by side, as many as give `bits` directions; keeps inner products."""
    copies = -(-bits // size)
    return np.concatenate([rotation(size, seed + 100_000 + r) for r in range(copies)], axis=1) / math.sqrt(copies)


def encoded(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary codes (signs of the rotated vectors, packed) and correction factors of unit vectors.

    factor: the inner product of a rotated vector and its own code's direction.
    """
    rotated = unit @ stacked(unit.shape[1], seed)
    return np.packbits(rotated >= 0, axis=1), np.clip(np.abs(rotated).sum(axis=1) / math.sqrt(rotated.shape[1]), 1e-9, 1.0)


def code_radius(size: int, cosine: float, z: float = 8.0) -> float:
    """Differing bits of two codes, at most, of vectors at `cosine`: each differs with the chance of their angle, z deviations up."""
    bits, share = size * -(-256 // size), math.acos(cosine) / math.pi
    return bits * share + z * math.sqrt(bits * share * (1 - share))


def close_codes(codes: np.ndarray, low: np.ndarray, high: np.ndarray, radius: float, chunk: int = 256, width: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, low[i] <= j < high[i]) whose codes (rows of bytes) differ in `radius` bits at most."""
    padded = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : codes.shape[1]] = codes
    words = np.ascontiguousarray(padded.view(np.uint64).T)
    asks = np.flatnonzero(high > low)
    for run in np.split(asks, np.flatnonzero(np.diff(high[asks])) + 1):
        for at in range(0, len(run), chunk):
            i = run[at : at + chunk]
            for first in range(int(low[i].min()), int(high[i[0]]), width):
                last = min(first + width, int(high[i[0]]))
                bits = np.zeros((len(i), last - first), dtype=np.uint16)
                for w in words:
                    bits += np.bitwise_count(w[i][:, None] ^ w[None, first:last])
                p, q = np.nonzero(bits <= radius)
                after = q + first >= low[i[p]]
                yield i[p[after]], q[after] + first


class Estimates:
    """Estimates of inner products from rotated vectors on one side, and codes with their factors on the other."""

    def __init__(self, unit: np.ndarray, codes: np.ndarray, factor: np.ndarray, seed: int):
        self.rotated = unit @ stacked(unit.shape[1], seed)
        bits = self.rotated.shape[1]
        self.directions = (np.unpackbits(codes, axis=1)[:, :bits] * 2.0 - 1.0) / math.sqrt(bits)
        self.factor, self.free = factor, max(1, bits - bits // unit.shape[1])

    def open_pairs(self, low: np.ndarray, high: np.ndarray, cosine: float, z: float = 8.0, chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, low[i] <= j < high[i]) whose cosine may reach `cosine`.

        With t the inner product of i's rotated vector and the direction of j's code, t / factor estimates the cosine
        without bias. A vector at cosine c is c times j's plus a rest in a random direction across it, so the
        estimate's deviation is sqrt(1 - c^2) * sqrt(1 - factor^2) / factor / sqrt(directions that are free). Pairs
        whose estimate plus z deviations stays below `cosine` are settled; the others are open.
        """
        wide = z * math.sqrt(max(0.0, 1 - cosine * cosine)) * np.sqrt(1 - self.factor**2) / self.factor / math.sqrt(self.free) + 1e-9
        asks = np.flatnonzero(high > low)
        for run in np.split(asks, np.flatnonzero(np.diff(high[asks])) + 1):
            for at in range(0, len(run), chunk):
                i = run[at : at + chunk]
                span = slice(int(low[i].min()), int(high[i[0]]))
                estimate = self.rotated[i] @ self.directions[span].T / self.factor[span]
                p, q = np.nonzero(estimate + wide[span] >= cosine)
                after = q + span.start >= low[i[p]]
                yield i[p[after]], q[after] + span.start


def _tables(label_rows: int, cell_rows: int, cosine: float, miss: float) -> tuple[int, int]:
    """Bits a table and tables, so that cells are near cell_rows and a pair at `cosine` is missed with chance `miss`.

    Up to 8 cells all pairs of a label meet in tiles, which takes fewer copies of a row than tables do.
    """
    if label_rows <= 8 * cell_rows:
        return 0, 1
    bits = bits_for(label_rows, cell_rows)
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - together))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, cell_rows: int = 8192, compare_rows: int = 4096, miss: float = 1e-6, seed: int = 7) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept.

    Vectors with the same label and size link at `cosine` or more. Equal vectors of a label are one class first, and
    count with their number. Each class gets a binary code and its correction factor once. Codes alone meet in cells:
    all of a label's while they are few, else those that agree on some signs of further rotations in one of several
    tables (more rows: more signs and tables; the chance to miss a pair right at the threshold stays below `miss`).
    Codes within code_radius make candidate components, and only those are sent with their vectors, once each: there
    estimates from codes and factors with their confidence bounds settle most pairs, and open pairs are recomputed
    exactly. No pair is sent: groups return sums of links and at most one link a class for the components.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing:
    n_links 0, own id as component_id, kept (not if the id is null). Repeated ids are several vectors of one name; an
    empty table gives an empty result; other columns are not returned.
    """
    rows = df.select(F.col(id_col).alias("id"), _floats(df, vector).alias("v"), F.col(label).alias("label"))
    rows = rows.withColumn("node", F.when(usable("v") & F.col("label").isNotNull(), F.xxhash64("label", "v")))
    classes = rows.where("node is not null").groupBy("node", "label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = written(classes.withColumn("size", F.size("v")), "classes")
    largest = classes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    bits, tables = _tables(largest, cell_rows, cosine, miss)

    @F.pandas_udf("code binary, factor double, keys array<bigint>")
    def coded(vectors: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(vectors)
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = _unit(np.stack([np.asarray(vectors.iloc[i], dtype=np.float64) for i in at]))
            codes, factor = encoded(x, seed)
            keys = np.zeros((len(at), 1), dtype=np.int64)
            if bits:
                signs = np.concatenate([x @ rotation(size, seed + 1000 + r) for r in range(-(-tables * bits // size))], axis=1) >= 0
                keys = (signs[:, : tables * bits].reshape(len(at), tables, bits) * (1 << np.arange(bits))).sum(axis=2)
            for i, c, f, k in zip(at, codes, factor, keys):
                out[i] = (c.tobytes(), f, k)
        return pd.DataFrame(out, columns=["code", "factor", "keys"])

    coded_classes = written(classes.select("node", "label", "size", coded("v").alias("c")).select("node", "label", "size", "c.*"), "codes")
    cells = coded_classes.select("node", "size", "code", "label", F.posexplode("keys").alias("table", "key"))
    cells = packed(cells.select("node", "size", "code", F.xxhash64("label", "size", "table", "key").alias("cell")), ["cell"], "node", cell_rows)

    def screened(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for size, part in group.groupby("size"):
            part = part.sort_values(["cell", "tile", "node"])
            node = part["node"].to_numpy(np.int64)
            low, high = runs(part["cell"].to_numpy(np.int64), part["tile"].to_numpy(), int(part["tile_a"].iloc[0]), int(part["tile_b"].iloc[0]))
            codes = np.frombuffer(b"".join(part["code"]), dtype=np.uint8).reshape(len(part), -1)
            root = least_linked(len(node), close_codes(codes, low, high, code_radius(int(size), cosine)))
            moved = np.flatnonzero(root != np.arange(len(node)))
            found.append(pd.DataFrame({"a": node[moved], "b": node[root[moved]]}))
        return pd.concat(found)

    candidates = connected_components(cells.groupBy("bucket", "tile_a", "tile_b").applyInPandas(screened, "a bigint, b bigint"), "a", "b")
    candidates = written(candidates.union(candidates.select("component", "component").distinct()), "candidates")
    candidates = written(packed(candidates, ["component"], "node", compare_rows), "tiles")
    vectors = classes.join(coded_classes.select("node", "code", "factor"), "node").select("node", "n", "v", "size", "code", "factor")
    vectors = vectors.join(perhaps_broadcast(candidates), "node")

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, part in group.groupby("size"):
            part = part.sort_values(["component", "tile", "node"])
            node, n = part["node"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
            low, high = runs(part["component"].to_numpy(np.int64), part["tile"].to_numpy(), int(part["tile_a"].iloc[0]), int(part["tile_b"].iloc[0]))
            x = np.stack(part["v"].to_numpy()).astype(np.float64)
            codes = np.frombuffer(b"".join(part["code"]), dtype=np.uint8).reshape(len(part), -1)
            links = np.zeros(len(node), dtype=np.int64)

            def linked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for i, j in Estimates(_unit(x), codes, part["factor"].to_numpy(), seed).open_pairs(low, high, cosine):  # noqa: B023
                    for at in range(0, len(i), 200_000):
                        p, q = i[at : at + 200_000], j[at : at + 200_000]
                        same = cosines(x[p], x[q]) >= cosine  # noqa: B023
                        p, q = p[same], q[same]
                        np.add.at(links, p, n[q])  # noqa: B023
                        np.add.at(links, q, n[p])  # noqa: B023
                        yield p, q

            root = least_linked(len(node), linked())
            some = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
            found.append(pd.DataFrame({"node": node[some], "root": node[root[some]], "links": links[some]}))
        return pd.concat(found)

    found = written(vectors.groupBy("bucket", "tile_a", "tile_b").applyInPandas(compared, "node bigint, root bigint, links bigint"), "links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("node", "root"), "node", "root").withColumnRenamed("component", "part")
    named = classes.select("node", "n", "least").join(sums, "node", "left").join(parts, "node", "left")
    named = written(named.withColumn("part", F.coalesce("part", "node")), "named")
    named = named.join(named.groupBy("part").agg(F.min("least").alias("component_id")), "part")
    named = named.select("node", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = joined(rows.select("id", "node"), named, "node", "n")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


class Forest:
    """Trees of sorted hash strings (64 signs of random projections) over one shard of vectors."""

    def __init__(self, unit: np.ndarray, trees: int, seed: int):
        rng = np.random.default_rng(seed)
        self.planes = [rng.standard_normal((unit.shape[1], 64)) for _ in range(trees)]
        strings = [self._strings(unit, p) for p in self.planes]
        self.order = [np.argsort(s, kind="stable") for s in strings]
        self.sorted = [s[o] for s, o in zip(strings, self.order)]

    @staticmethod
    def _strings(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ planes >= 0, axis=1).view(">u8").ravel().astype(np.uint64)

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the rows that share a prefix with it in some tree.

        Descends each tree to the longest prefix that any string shares, then ascends all trees together, one sign at a
        time and tree by tree, until their ranges hold `enough` rows (with repeats) or everything.
        """
        own = [self._strings(queries, p) for p in self.planes]
        n, trees = len(self.order[0]), len(self.order)
        low = np.zeros((trees, len(queries)), dtype=np.int64)
        high = np.zeros((trees, len(queries)), dtype=np.int64)
        total = np.zeros(len(queries), dtype=np.int64)
        at = np.arange(len(queries))
        for depth in range(64, -1, -1):
            mask = np.uint64((1 << 64) - (1 << (64 - depth)))
            for t in range(trees):
                if not len(at):
                    break
                first = own[t][at] & mask
                total[at] -= high[t, at] - low[t, at]
                low[t, at] = np.searchsorted(self.sorted[t], first, "left")
                high[t, at] = np.searchsorted(self.sorted[t], first | ~mask, "right")
                total[at] += high[t, at] - low[t, at]
                at = at[total[at] < enough]
        for q in range(len(queries)):
            seen = np.zeros(n, dtype=bool)
            for t in range(trees):
                seen[self.order[t][low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(seen)


def _floats(df: DataFrame, vector: str) -> Column:
    """The vector as floats if it has that type (half as long to send), else as doubles."""
    return F.col(vector).cast(df.schema[vector].dataType if df.schema[vector].dataType == T.ArrayType(T.FloatType()) else "array<double>")


class _Search:
    """A shard of vectors of one size, and the search of query vectors in its forest."""

    def __init__(self, part: pd.DataFrame, trees: int, seed: int, share: float, least: int, k: int):
        self.x = np.stack(part["v"].to_numpy()).astype(np.float64)
        self.ids, self.k = part["ids"].to_numpy(), k
        self.forest = Forest(_unit(self.x), trees, seed)
        self.enough = int(max(least, share * len(self.x)))

    def found(self, part: pd.DataFrame) -> Iterator[tuple[int, int, float]]:
        """(query's node, id, score) of the k + 1 nearest found rows of each query, ties by id."""
        y, k = np.stack(part["v"].to_numpy()).astype(np.float64), self.k
        for q, rows in enumerate(self.forest.candidates(_unit(y), self.enough)):
            score = cosines(self.x[rows], np.broadcast_to(y[q], (len(rows), y.shape[1])))
            # k + 1 classes at least: one of them may hold the query's own row alone; ties at the end are all kept.
            cut = np.partition(score, len(score) - k - 1)[len(score) - k - 1] if len(score) > k + 1 else -np.inf
            best = sorted((-score[i], int(one)) for i in np.flatnonzero(score >= cut) for one in self.ids[rows[i]])[: k + 1]
            yield from ((int(part["node"].iloc[q]), one, -far) for far, one in best)


def nearest(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int | None = None, trees: int = 48, share: float = 0.75, least: int = 1024, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`, by cosine.

    Equal vectors are one class, of which the k + 1 smallest ids can be results. Classes are dealt by hash to shards of
    about shard_rows (by default 8,192 to 65,536, more where there are more rows). A task reads a shard, builds its
    forest once (every class is in each of its trees), and answers the distinct query vectors that stream in behind it;
    the best of all shards, merged in two levels, are a query's result. A shard looks at rows until its trees' ranges
    add up to max(least, share * rows) with repeats, so its candidates are about half of it where neighbours are far
    apart, and the whole of a small shard.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; only
    vectors of equal size meet. Rows that repeat a query's id are that query: its own rows are no candidates of it.
    Ties go to the smaller id. Empty tables give empty results; other columns are not returned.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), _floats(df, vector).alias("v")).where(usable("v") & F.col("id").isNotNull()).distinct()
    rows = written(rows.withColumn("node", F.xxhash64("v")), "vectors")
    classes = written(rows.groupBy("node", "v").agg(F.lit(1).alias("one")).drop("one").join(_smallest_ids(rows, k + 1), "node"), "classes")
    count = classes.count()
    shards = max(1, -(-count // (shard_rows or max(8192, min(65_536, count // 64)))))
    asked = written(rows.where(F.col("id") % every == 0), "queries")
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.col("node")), F.lit(shards)).cast("int")
    index = classes.select(shard.alias("shard"), F.size("v").alias("size"), F.lit(0).alias("asks"), "node", "v", "ids")
    to_all = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    queries = asked.select("node", "v").distinct().select(to_all.alias("shard"), F.size("v").alias("size"), F.lit(1).alias("asks"), "node", "v")
    stream = index.unionByName(queries, allowMissingColumns=True).repartition(shards, "shard").sortWithinPartitions("shard", "size", "asks", "node")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, ready = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for key, part in batch.groupby(["shard", "size", "asks"]):
                if key[:2] != at:
                    at, held, ready = key[:2], [], None
                if not key[2]:
                    held.append(part)
                elif held or ready:
                    ready = ready or _Search(pd.concat(held), trees, seed, share, least, k)
                    held = []
                    out += ready.found(part)
            yield pd.DataFrame(out, columns=["node", "vec_id", "score"]).astype({"node": "int64", "vec_id": "int64", "score": "float64"})

    found = stream.mapInPandas(search, "node bigint, vec_id bigint, score double").select("node", F.struct((-F.col("score")).alias("far"), "vec_id").alias("hit"))
    top = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, k + 1)
    part = F.pmod(F.xxhash64("hit"), F.lit(math.isqrt(shards) + 1))
    some = found.groupBy("node", part.alias("part")).agg(top("hit").alias("best"))
    best = some.select("node", F.explode("best").alias("hit")).groupBy("node").agg(top("hit").alias("best"))
    hits = asked.select(F.col("id").alias("query_id"), "node").join(best, "node")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    hits = hits.select("query_id", F.posexplode(others).alias("at", "hit"))
    return hits.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))


def _smallest_ids(rows: DataFrame, n: int, salts: int = 64) -> DataFrame:
    """(node, ids): the n smallest distinct ids of each class, first within `salts` parts of it, then of those."""
    smallest = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, n)
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("id")), F.lit(salts))
    some = rows.groupBy("node", part.alias("part")).agg(smallest("id").alias("ids"))
    return some.select("node", F.explode("ids").alias("id")).groupBy("node").agg(smallest("id").alias("ids"))
