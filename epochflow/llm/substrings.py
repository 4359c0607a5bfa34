"""Substring dedup: words covered by a run of `window` words that also starts elsewhere are removed.

Suffixes begin at window starts and matter to a depth of `window` words. In each window the least hash of its short
word runs marks an anchor, the same in every copy of that window; successive starts with one anchor are a row, so that
a row stands for some 14 suffixes and two equal windows lie in rows of one prefix (the anchor's words). Prefixes that
occur once are dropped before any text is sent. Rows of one prefix and equal words all around are settled by their
count; what is left of a prefix (rows that differ somewhere) is sent with its words, and suffix trees of memory-sized
groups of prefixes tell by their deep internal nodes which windows repeat. A prefix with too many different rows is
split by longer prefixes, down to whole windows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, written

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are cut into words at a time, and words that are hashed at a time.
_PIECE_BYTES, _STREAM_WORDS = 4_000_000, 1_000_000
_ROWS = "doc bigint, twin bigint, lo int, hi int, anchor int, prefix bigint, body bigint"
_BASE = 0x9E3779B97F4A7C15 | 1


class _Hashes(dict):
    """64-bit hashes of words, kept for their next occurrence."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a few megabytes at a time."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + _PIECE_BYTES) if at + _PIECE_BYTES < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Runs:
    """Hashes of runs of words [start, end), alike wherever they stand; a polynomial over the words' hashes."""

    def __init__(self, words: np.ndarray):
        powers = np.full(len(words) + 1, np.uint64(_BASE))
        powers[0] = 1
        back = np.full(len(words) + 1, np.uint64(pow(_BASE, -1, 1 << 64)))
        back[0] = 1
        self.back = np.cumprod(back, dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(words * np.cumprod(powers, dtype=np.uint64)[:-1], dtype=np.uint64))

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64), seed)


def anchored(words: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(lo, hi, anchor, prefix, body) of texts whose word hashes follow each other, each text up to its end.

    Windows that start at lo to hi all have their anchor, the rightmost least hash of `gram` words, at one place;
    prefix hashes those words, body all words from lo to hi + window.
    """
    n = len(words)
    of = _Runs(words)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    starts = np.arange(max(0, n - window + 1))
    starts = starts[text[: len(starts)] == text[window - 1 :]] if len(starts) else starts
    if not len(starts):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    grams = np.arange(n - gram + 1)
    value = of(grams, grams + gram)
    reach, least, width = window - gram + 1, grams, 1
    while width < reach:  # least of 1, 2, 4, ... successive runs
        step = min(width, reach - width)
        left, right = least[: len(least) - step], least[step:]
        least = np.where(value[right] <= value[left], right, left)
        width += step
    anchor = least[starts]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(starts) != 1)]))
    lo, hi, at = starts[first], starts[np.append(first[1:], len(starts)) - 1], anchor[first]
    return lo, hi, at, _mixed(value[at], 1).view(np.int64), of(lo, hi + window, 2).view(np.int64)


def _keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """text with two hashes of id and text, by which equal rows (whose results are equal, too) find their ranges."""
    key = [F.xxhash64(F.lit(name), F.col(id_col), F.col(text)).alias(name) for name in ("doc", "twin")]
    return df.select(*key, F.col(text).alias("text"))


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows of _ROWS: a range of window starts in a document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        held: list[np.ndarray] = []
        owners: list[tuple] = []  # document and number of its words before the part
        size = 0

        def done() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held])
            lo, hi, at, prefix, body = anchored(np.concatenate(held), ends, window, gram)
            part = np.searchsorted(ends, lo, side="right")
            doc, twin, before = (np.array(x, dtype=np.int64)[part] for x in zip(*owners))
            before = before - (ends - [len(x) for x in held])[part]
            held.clear()
            owners.clear()
            places = [pa.array((x + before).astype(np.int32)) for x in (lo, hi, at)]
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(twin), *places, pa.array(prefix), pa.array(body)], names=[c.split()[0] for c in _ROWS.split(", ")])

        for batch in batches:
            for doc, twin, text in zip(*(batch[c].to_pylist() for c in ("doc", "twin", "text"))):
                tail, before = np.zeros(0, dtype=np.uint64), 0
                for words in _pieces((text or "").encode("utf-8", "replace")):
                    new = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
                    part = np.concatenate([tail, new])
                    if len(part) >= window:
                        held.append(part)
                        owners.append((doc, twin, before))
                        size += len(part)
                    tail = part[max(0, len(part) - window + 1) :]
                    before += len(part) - len(tail)
                    if size > _STREAM_WORDS:
                        yield done()
                        size = 0
        if held:
            yield done()

    return docs.mapInArrow(found, _ROWS)


def _settled(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranges that repeat as a whole, rows for trees, rows to be split).

    Rows of equal prefix and body are one sequence of words: more than one of them repeat. Of each such sequence one
    row (column n: how often) stays to be compared with others of its prefix, if there are others.
    """
    place = [c for c in rows.columns if c not in ("prefix", "body", "n")]
    classes = rows.groupBy("prefix", "body").agg(F.sum("n").alias("n"), F.min_by(F.struct(*place), F.struct("doc", "twin", "lo")).alias("row"))
    classes = written(classes, "classes")
    several = written(classes.groupBy("prefix").agg(F.count(F.lit(1)).alias("others")).where("others > 1"), "prefixes")
    twice = classes.where("n > 1").select(F.struct("prefix", "body").alias("key"), "n", F.lit(True).alias("again"))
    again = joined(rows.withColumn("key", F.struct("prefix", "body")), written(twice, "twice"), "key", "n").where("again")
    open_ = joined(classes, several.withColumn("shared", F.col("others")), "prefix", "others").where("shared IS NOT NULL")
    open_ = open_.select("prefix", "body", "n", "row.*", "shared")
    return again.select("doc", "twin", "lo", "hi"), open_.where(F.col("shared") <= most).drop("shared"), open_.where(F.col("shared") > most).drop("shared")


def _with_words(rows: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """rows with their words (column words, joined by spaces), from lo to hi + window."""
    fields = [c for c in rows.columns if c not in ("doc", "twin")]
    asked = rows.groupBy("doc", "twin").agg(F.sort_array(F.collect_list(F.struct("lo", *[c for c in fields if c != "lo"]))).alias("asked"))

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, starts, ends in batches:
            out = []
            for text, lo, hi in zip(texts, starts, ends):
                parts, held, before, at = [], [], 0, 0
                for words in _pieces((text or "").encode("utf-8", "replace")):
                    held += words
                    while at < len(lo) and hi[at] + window <= before + len(held):
                        parts.append(b" ".join(held[lo[at] - before : hi[at] + window - before]).decode())
                        at += 1
                    if at == len(lo):
                        break
                    gone = max(0, min(lo[at] - before, len(held)))
                    held, before = held[gone:], before + gone
                out.append(parts)
            yield pd.Series(out, dtype=object)

    # Rows of equal id and text have equal ranges: one of them is enough.
    found = docs.join(asked, ["doc", "twin"]).dropDuplicates(["doc", "twin"])
    found = found.select("doc", "twin", "asked", cut("text", "asked.lo", "asked.hi").alias("cut"))
    found = found.select("doc", "twin", F.explode(F.arrays_zip("asked", "cut")).alias("x"))
    return found.select("doc", "twin", *[F.col(f"x.asked.{c}").alias(c) for c in fields], F.col("x.cut").alias("words"))


def tree(symbols: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of suffixes at `starts`, to a depth: their order, and how many symbols each shares with the one before.

    Names of runs of 1, 2, 4, ... symbols (equal runs, equal names, in order) sort the suffixes and measure what
    neighbours share. A node of the tree is a stretch of the order within which neighbours share that node's depth.
    """
    names, width = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)], 1
    while 2 * width <= depth:
        last = names[-1]
        after = np.append(last[width:], np.full(min(width, len(last)), -1, dtype=np.int32)) + 1
        names.append(np.unique(last.astype(np.int64) * (len(last) + 2) + after, return_inverse=True)[1].astype(np.int32))
        width *= 2
    top = names[-1]
    order = starts[np.lexsort((top[starts + depth - width], top[starts]))]
    shared, left, right = np.zeros(len(order), dtype=np.int64), order[:-1], order[1:]
    for k in reversed(range(len(names))):
        for _ in range(1 if k < len(names) - 1 else 2):
            room = shared[1:] + (1 << k) <= depth
            at = np.where(room, shared[1:], 0)
            shared[1:] += np.where(room & (names[k][left + at] == names[k][right + at]), 1 << k, 0)
    return order, shared


def deep_leaves(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes below internal nodes of that depth or more: each has its words in common with another suffix."""
    deep = shared >= depth
    return order[deep | np.append(deep[1:], False)]


def _repeated(words: list[str], lo: np.ndarray, hi: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(row, first start, last start) of the windows of rows that another window of these rows equals."""
    number: dict[str, int] = {}
    parts = [np.array([number.setdefault(x, len(number)) for x in w.split(" ")], dtype=np.int32) for w in words]
    base = np.cumsum([0, *map(len, parts)])[:-1]
    symbols = np.concatenate(parts)
    n = hi - lo + 1
    row = np.repeat(np.arange(len(n)), n)
    starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[row]
    found = np.sort(deep_leaves(*tree(symbols, starts, window), window))
    of = np.searchsorted(base, found, side="right") - 1
    cuts = np.flatnonzero((np.diff(found) != 1) | (np.diff(of) != 0)) + 1
    return [(of[i], lo[of[i]] + found[i] - base[of[i]], lo[of[i]] + found[j - 1] - base[of[i]]) for i, j in pairwise([0, *cuts, len(found)]) if j > i]


def _from_trees(rows: DataFrame, window: int, group_rows: int) -> DataFrame:
    """Ranges of starts that repeat, from trees of about group_rows rows of whole prefixes."""

    def told(group: pd.DataFrame) -> pd.DataFrame:
        doc, twin, n = group["doc"].to_numpy(), group["twin"].to_numpy(), group["n"].to_numpy()
        found = [x for x in _repeated(list(group["words"]), group["lo"].to_numpy(np.int64), group["hi"].to_numpy(np.int64), window) if n[x[0]] == 1]
        return pd.DataFrame([(doc[r], twin[r], a, b) for r, a, b in found], columns=["doc", "twin", "lo", "hi"])

    groups = max(1, math.ceil(rows.count() / group_rows))
    group = F.pmod(F.xxhash64(F.lit("group"), "prefix"), F.lit(groups))
    return rows.groupBy(group).applyInPandas(told, "doc bigint, twin bigint, lo int, hi int")


def _split(rows: DataFrame, window: int) -> DataFrame:
    """Each row cut in two by where its windows start before the anchor; the words that all of a half's windows share
    (more than before) are the prefix of its rows."""

    def halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for doc, twin, lo, hi, anchor, n, near, far, words in zip(*(part[c] for c in ("doc", "twin", "lo", "hi", "anchor", "n", "near", "far", "words"))):
                tokens, middle = words.split(" "), (near + far) // 2
                for a, b in ((near, middle), (middle + 1, far)):
                    first, last = max(lo, anchor - b), min(hi, anchor - a)
                    if first <= last:
                        core = f"{a} {b} " + " ".join(tokens[anchor - a - lo : anchor - b + window - lo])
                        body = " ".join(tokens[first - lo : last + window - lo])
                        prints = np.array([xxhash.xxh64_intdigest(core), xxhash.xxh64_intdigest(body)], dtype=np.uint64).view(np.int64)
                        out.append((doc, twin, first, last, anchor, *prints, n, a, b, body))
            yield pd.DataFrame(out, columns=["doc", "twin", "lo", "hi", "anchor", "prefix", "body", "n", "near", "far", "words"])

    return rows.mapInPandas(halves, f"{_ROWS}, n bigint, near int, far int, words string")


def repeated_ranges(docs: DataFrame, window: int = 35, gram: int = 8, most: int = 3_000, group_rows: int = 3_000) -> DataFrame:
    """(doc, twin, lo, hi): ranges of window starts whose words also start elsewhere; docs as of _keyed()."""
    gram = min(gram, window)
    rows = written(_anchors(docs, window, gram), "anchors")
    counts = written(rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts").withColumn("again", F.lit(True))
    rows = joined(rows, counts, "prefix", "n").where("again").drop("again")
    rows = written(rows.withColumn("n", F.lit(1).cast("bigint")), "rows")
    whole, light, heavy = _settled(rows, most)
    both = light.withColumn("heavy", F.lit(False)).unionByName(heavy.withColumn("heavy", F.lit(True)))
    both = written(_with_words(both, docs, window), "words")
    out = whole.unionByName(_from_trees(both.where("NOT heavy"), window, group_rows))
    rows = both.where("heavy").drop("heavy").withColumns({"near": F.lit(0), "far": F.lit(window - gram)})
    while not rows.isEmpty():
        whole, light, heavy = _settled(written(_split(rows, window), "halves"), most)
        out = out.unionByName(whole).unionByName(_from_trees(light, window, group_rows))
        rows = written(heavy, "heavy")
    return out


def _covered(lo: np.ndarray | None, hi: np.ndarray | None, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, ordered ranges (start, end) of words that windows starting at lo to hi cover."""
    if lo is None or not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order].astype(np.int64), np.maximum.accumulate(hi[order].astype(np.int64) + window)
    first = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[first], hi[np.append(np.flatnonzero(first)[1:], len(lo)) - 1]


def _kept(text: str | None, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words, those that are not covered) of a text, piece by piece."""
    before = 0
    for words in _pieces((text or "").encode("utf-8", "replace")):
        keep, at = [], before
        end = before + len(words)
        for k in range(int(np.searchsorted(ends, before, side="right")), int(np.searchsorted(starts, end))):
            keep += words[at - before : max(at, int(starts[k])) - before]
            at = max(at, min(int(ends[k]), end))
        yield len(words), keep + words[at - before :]
        before = end


def _told(df: DataFrame, id_col: str, text: str, window: int, finding: dict) -> DataFrame:
    """df's columns as _c0, _c1, ..., the text, and the ranges of each row."""
    ranges = repeated_ranges(_keyed(df, id_col, text), window, **finding)
    ranges = ranges.groupBy("doc", "twin").agg(F.collect_list(F.struct("lo", "hi")).alias("_ranges")).select("doc", "twin", F.col("_ranges.lo").alias("_lo"), F.col("_ranges.hi").alias("_hi"))
    key = _keyed(df, id_col, text)
    rows = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)], *[F.xxhash64(F.lit(name), F.col(id_col), F.col(text)).alias(name) for name in key.columns[:2]])
    return rows.join(ranges, ["doc", "twin"], "left")


def removed(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 35, **finding) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes if a run of `window` words covers it that starts anywhere else, too, in the same text or another one;
    rows are judged on the input. Texts of fewer words keep all of them; null and empty texts have none, and the digest
    of nothing; repeated rows are copies of each other and stay; null ids are ids like others; an empty table gives an
    empty result; other columns are neither read nor returned. Texts of any length are read piece by piece.
    """

    @F.pandas_udf("n_words bigint, n_removed bigint, kept_sha256 string")
    def digest(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for t, lo, hi in zip(*part):
                n, left, sha = 0, 0, hashlib.sha256()
                for words, keep in _kept(t, *_covered(lo, hi, window)):
                    if keep:
                        sha.update((b" " if left else b"") + b" ".join(keep))
                    n, left = n + words, left + len(keep)
                out.append((n, n - left, sha.hexdigest()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    source = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    out = _told(source, "id", "text", window, finding)
    return out.select(F.col("_c0").alias(id_col), digest("_c1", "_lo", "_hi").alias("d")).select(id_col, "d.*")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 35, **finding) -> DataFrame:
    """df with the kept words of each text, joined by one space; texts that lose no word stay as they are. See removed()."""

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([t if lo is None else b" ".join(w for _, keep in _kept(t, *_covered(lo, hi, window)) for w in keep).decode() for t, lo, hi in zip(*part)], dtype=object)

    out = _told(df, id_col, text, window, finding)
    return out.select(*[(cleaned(f"_c{i}", "_lo", "_hi") if c == text else F.col(f"_c{i}")).alias(c) for i, c in enumerate(df.columns)])
