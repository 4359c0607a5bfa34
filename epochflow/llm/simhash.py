"""SimHash near-duplicates: 64-bit fingerprints, compared bit-sliced inside exact candidate cells."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_for, connected_components, joined, least_linked, merge_roots, packed, perhaps_broadcast, runs, tiled, words_of, written

#: (bands, bands that must agree): two words that differ in at most r bits agree on bands - r whole bands or more.
_LADDER = (1, 2, 3, 4, 6)


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles in order, repeats included; of the whole sequence where that is shorter; none without words."""
    words = words_of(text)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    joined_ = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return np.array([digest(joined_[s : e - 1], seed) for s, e in zip(starts, starts[shingle:])], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    packed_ = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(packed_, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority of the XXH64 bits over all word shingles, repeats included; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle, seed))


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = 4, out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a bigint that holds the unsigned 64 bits."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return df.withColumn(out, of(F.col(text)))


def _over(counters: list[np.ndarray], spilled: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the lanes whose count, spread over the counters' bit planes, is above the radius."""
    above, equal = spilled.copy(), ~spilled
    for k in reversed(range(len(counters))):
        if not radius >> k & 1:
            above |= equal & counters[k]
            equal &= ~counters[k]
        else:
            equal &= counters[k]
    return above


def _planes(rows: np.ndarray) -> np.ndarray:
    """Rows stored vertically: one 64-bit word of a plane holds the same bit of 64 rows."""
    padded = np.zeros(-(-len(rows) // 64) * 64, dtype=np.uint64)
    padded[: len(rows)] = rows
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _sliced(planes: np.ndarray, queries: np.ndarray, who: np.ndarray, word: np.ndarray, real: np.ndarray, radius: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs within the radius, of the queries `who` with the lanes `real` of the words `word`.

    A carry-save counter of a few bit planes sums the differing bits of 64 rows at once; after each `step` planes,
    words whose real rows are all beyond the radius are abandoned.
    """
    ones, depth = np.uint64(0xFFFFFFFFFFFFFFFF), max(radius, 1).bit_length()
    flips = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ones, np.uint64(0))
    counters, spilled = [np.zeros(len(who), np.uint64) for _ in range(depth)], np.zeros(len(who), np.uint64)
    for first in range(0, 64, step):
        for plane in range(first, first + step):
            carry = planes[plane][word] ^ flips[who, plane]
            for k in range(depth):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            spilled |= carry
        alive = (_over(counters, spilled, radius) & real) != real
        if not alive.all():
            who, word, real, spilled = who[alive], word[alive], real[alive], spilled[alive]
            counters = [c[alive] for c in counters]
        if not len(who):
            break
    close = ~_over(counters, spilled, radius) & real
    lanes = np.unpackbits(close.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    pair, lane = np.nonzero(lanes)
    return who[pair], word[pair] * 64 + lane


def near(queries: np.ndarray, rows: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query with any, the rows within the Hamming radius."""
    width, planes = -(-len(rows) // 64), _planes(rows)
    lanes = np.packbits(np.arange(width * 64) < len(rows), bitorder="little").view("<u8")
    block = max(1, (1 << 18) // max(width, 1))
    for start in range(0, len(queries), block):
        part = queries[start : start + block]
        word = np.tile(np.arange(width), len(part))
        query, row = _sliced(planes, part, np.repeat(np.arange(len(part)), width), word, lanes[word], radius)
        cuts = np.flatnonzero(np.diff(query)) + 1
        for q, r in zip(np.split(query, cuts), np.split(row, cuts)):
            if len(q):
                yield start + int(q[0]), r


def near_in_runs(prints: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with low[i] <= j < high[i] within the radius, in blocks of about `block` words of 64 rows."""
    planes = _planes(prints)
    asks = np.flatnonzero(high > low)
    words = (high[asks] - 1) // 64 - low[asks] // 64 + 1
    cuts = np.searchsorted(np.cumsum(words), np.arange(block, words.sum() + block, block))
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for part, n in zip(np.split(asks, cuts), np.split(words, cuts)):
        if not len(part):
            continue
        who = np.repeat(np.arange(len(part)), n)
        word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (low[part] // 64)[who]
        below = np.clip(low[part][who] - word * 64, 0, 63).astype(np.uint64)
        above = np.clip(64 - (high[part][who] - word * 64), 0, 63).astype(np.uint64)
        query, row = _sliced(planes, prints[part], who, word, (ones << below) & (ones >> above), radius)
        yield part[query], row


def _cell_keys(fp, rows: int, radius: int, cell_rows: int) -> list:
    """One (number, key) struct for each choice of bands that may agree; bands and choices grow with the rows."""
    want = bits_for(rows, cell_rows)
    for agree in _LADDER:
        bands = radius + agree
        if agree * (64 // bands) >= want or agree == _LADDER[-1]:
            break
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(bands), agree)):
        key, room = F.lit(0).cast("bigint"), want
        for i, band in enumerate(chosen):
            size = min(edges[band + 1] - edges[band], -(-room // (agree - i)))
            room -= size
            if size > 0:
                key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, edges[band]).bitwiseAND(F.lit((1 << size) - 1).cast("bigint")))
        out.append(F.struct(F.lit(n).alias("choice"), key.alias("key")))
    return out


def link_fingerprints(fingerprints: DataFrame, column: str, radius: int = 4, cell_rows: int = 2048) -> DataFrame:
    """(node, component) for distinct fingerprints that link to another one, directly or by others.

    Candidates are exact: with radius + k bands, two linked fingerprints agree on k whole bands, so they meet in the
    cell of that choice of bands; more rows take larger k and longer keys, which keeps cells near cell_rows. Cells that
    stay large are cut into tiles. A cell returns at most one link a fingerprint, never its pairs.
    """
    rows = fingerprints.count()
    cells = fingerprints.select(F.col(column).alias("fp"), F.explode(F.array(*_cell_keys(F.col(column), rows, radius, cell_rows))).alias("c")).select("fp", "c.choice", "c.key")
    cells = tiled(cells, ["choice", "key"], "fp", 4 * cell_rows)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = int(group["tile_a"].iloc[0]), int(group["tile_b"].iloc[0])
        group = group.sort_values(["tile", "fp"])
        fps, tile = group["fp"].to_numpy(np.int64).view(np.uint64), group["tile"].to_numpy()
        left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        root = np.arange(len(fps))
        for q, found in near(fps[left], fps[right], radius):
            merge_roots(root, np.append(right[found], left[q]))
        moved = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[moved].view(np.int64), "b": fps[root[moved]].view(np.int64)})

    links = cells.groupBy("choice", "key", "tile_a", "tile_b").applyInPandas(compare, "a bigint, b bigint")
    return connected_components(links, "a", "b")


def _labelled(df: DataFrame, id_col: str, text: str, radius: int, shingle: int) -> DataFrame:
    """(id, fp, body, component, component_id) of each row; body is a hash of the exact text."""
    source = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    prints = with_fingerprint(source, "text", shingle, "fp").select("id", "fp", F.xxhash64("text").alias("body"))
    prints = written(prints, "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    labels = link_fingerprints(classes.select("fp"), "fp", radius)
    named = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined(prints, named.join(smallest, "component").select("fp", "n", "component", "component_id"), "fp", "n")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable by links (fingerprints at `radius` bits or fewer), the own id included.
    Null and empty texts have fingerprint zero and link like others; null ids count as no id (a component of null ids
    only has a null component_id); repeated rows stay repeated; an empty table gives an empty result. Other columns
    are neither read nor returned.
    """
    found = _labelled(df, id_col, text, radius, shingle)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _pairs_of(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def band_keys(hashes: np.ndarray, bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """A key for each band: of its number, and the least values of the shingles under `rows` seeded permutations."""
    mask, factor = _pairs_of(bands * rows, seed)
    least = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 8192):
        least = np.minimum(least, ((hashes[None, at : at + 8192] ^ mask[:, None]) * factor[:, None]).min(axis=1))
    keys = np.arange(bands, dtype=np.uint64) * factor[0]
    for part in least.reshape(bands, rows).T:
        keys = (keys ^ part) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def verified(sets: list[np.ndarray], low: np.ndarray, high: np.ndarray, similarity: float) -> np.ndarray:
    """The smallest row that each row reaches by pairs (i, low[i] <= j < high[i]) whose sets' Jaccard is `similarity` or more.

    A row is compared with all rows that it isn't linked to yet, by one search of all their shingles in its own.
    """
    root, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    for i in np.flatnonzero(high > low):
        j = np.arange(low[i], high[i])
        j = j[(root[j] != root[i]) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]))]
        if not len(j):
            continue
        both = np.concatenate([sets[k] for k in j])
        place = np.minimum(np.searchsorted(sets[i], both), max(len(sets[i]) - 1, 0))
        hit = sets[i][place] == both if len(sets[i]) else np.zeros(len(both), bool)
        common = np.bincount(np.repeat(np.arange(len(j)), sizes[j])[hit], minlength=len(j))
        same = common >= similarity * (sizes[j] + sizes[i] - common) - 1e-9
        if same.any():
            merge_roots(root, np.append(j[same], i))
    return root


def link_similar(prints: DataFrame, texts: DataFrame, key: str, similarity: float, shingle: int, radius: int, cell_rows: int = 4096, compare_rows: int = 1024) -> DataFrame:
    """(node, component) for distinct word sequences that link to another one.

    prints: node, fp, keys, number of shingles and key of each; texts: key and text. Sequences of a cell (an equal band
    key) that are within the radius of each other's fingerprint are candidates, and make candidate components; only
    those are sent with their shingles to be compared exactly, so that no pair is sent at all.
    """
    cells = packed(prints.select("node", "fp", F.explode("keys").alias("key")), ["key"], "node", cell_rows)

    def screened(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "tile", "node"])
        node = group["node"].to_numpy(np.int64)
        low, high = runs(group["key"].to_numpy(np.int64), group["tile"].to_numpy(), int(group["tile_a"].iloc[0]), int(group["tile_b"].iloc[0]))
        root = least_linked(len(node), near_in_runs(group["fp"].to_numpy(np.int64).view(np.uint64), low, high, radius))
        moved = np.flatnonzero(root != np.arange(len(node)))
        return pd.DataFrame({"a": node[moved], "b": node[root[moved]]}).drop_duplicates()

    found = cells.groupBy("bucket", "tile_a", "tile_b").applyInPandas(screened, "a bigint, b bigint")
    candidates = connected_components(found, "a", "b")
    candidates = candidates.union(candidates.select("component", "component").distinct()).join(prints.select("node", "n_shingles", key), "node")
    candidates = written(candidates, "candidates")
    candidates = written(packed(candidates, ["component"], "node", compare_rows, F.col("n_shingles") / 2048.0 + 1.0), "tiles")

    @F.pandas_udf("array<bigint>")
    def distinct(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in rows], dtype=object)

    sets = texts.join(perhaps_broadcast(candidates), key).select("node", "component", "bucket", "tile", "tile_a", "tile_b", distinct("text").alias("shingles"))

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["component", "tile", "node"])
        node = group["node"].to_numpy(np.int64)
        low, high = runs(group["component"].to_numpy(np.int64), group["tile"].to_numpy(), int(group["tile_a"].iloc[0]), int(group["tile_b"].iloc[0]))
        root = verified([np.sort(np.asarray(s, dtype=np.int64)) for s in group["shingles"]], low, high, similarity)
        moved = np.flatnonzero(root != np.arange(len(node)))
        return pd.DataFrame({"a": node[moved], "b": node[root[moved]]})

    links = sets.groupBy("bucket", "tile_a", "tile_b").applyInPandas(compared, "a bigint, b bigint")
    return connected_components(links, "a", "b")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5, radius: int = 20, bands: int = 16, rows: int = 4) -> DataFrame:
    """One row of df for each group of near-duplicates: that of the smallest id (null last), with all columns of df.

    Texts link if the Jaccard similarity of their sets of word shingles is `similarity` or more, and groups are what
    links reach. Candidates share a band of least hashes and differ in `radius` bits of their fingerprints at most; each is
    compared exactly. At a similarity of 0.8 right at the threshold, two texts share a band with chance 0.9998, and
    their fingerprints (mean distance 9.7 of 64 bits, deviation 2.9) are within 20 bits with chance 0.9998.

    Rows of the smallest id with different texts are told apart by a hash of the text, then by none: one stays. Null
    and empty texts are one group; an empty table gives an empty result.
    """
    at = next(f"_key{i}" for i in range(len(df.columns) + 1) if f"_key{i}" not in df.columns)
    keyed = df.withColumn(at, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("body")))

    @F.pandas_udf("node bigint, fp bigint, n_shingles int, keys array<bigint>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for t in part:
                h = shingle_hashes(t, shingle)
                whole = np.array([xxhash.xxh64_intdigest(b" ".join(words_of(t)), 1), majority(h)], dtype=np.uint64).view(np.int64)
                out.append((whole[0], whole[1], len(h), band_keys(h, bands, rows)))
            yield pd.DataFrame(out, columns=["node", "fp", "n_shingles", "keys"])

    prints = written(keyed.select(F.col(at), hashed(F.col(text)).alias("h")).select(at, "h.*"), "prints")
    twice = written(prints.groupBy(at).count().where("count > 1").select(at), "repeated")
    same = [F.first(c).alias(c) for c in ("fp", "n_shingles", "keys")]
    classes = written(prints.groupBy("node").agg(*same, F.min(at).alias(at), F.count(F.lit(1)).alias("n")), "classes")
    texts = keyed.select(at, F.col(text).alias("text"))
    if not twice.isEmpty():
        texts = texts.join(perhaps_broadcast(twice), at, "left_anti").union(texts.join(perhaps_broadcast(twice), at, "left_semi").groupBy(at).agg(F.first("text").alias("text")))
    links = link_similar(classes, texts, at, similarity, shingle, radius)
    named = classes.select("node", "n", at).join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = named.groupBy("component").agg(F.min(at).alias("kept"))
    named = written(named.join(kept, "component").select("node", "n", "kept"), "components")
    gone = joined(prints.select(at, "node"), named, "node", "n").where(~F.col(at).eqNullSafe(F.col("kept"))).select(at)
    out = keyed.join(perhaps_broadcast(written(gone.distinct(), "gone")), at, "left_anti")
    if not twice.isEmpty():
        once = out.join(perhaps_broadcast(twice), at, "left_semi").dropDuplicates([at])
        out = out.join(perhaps_broadcast(twice), at, "left_anti").unionByName(once)
    return out.drop(at)
