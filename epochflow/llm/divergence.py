"""Divergence of sources within a language, from exact counts of terms.

A term's share in a group depends only on how often it occurs there, so two groups are compared by count levels: a
bitmap of term numbers for each (group, count), AND and popcount for the number of terms that have one count here and
another there, times the divergence of those two shares. Terms that a group lacks follow by complement.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import perhaps_broadcast, tiled, written

#: Bytes: A-Z lower-cased, other ASCII but letters to a space, the rest kept.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_SCALE = 1_000_000_000
#: A level of fewer terms than this in a chunk is kept as term numbers instead of a bitmap.
_SPARSE = 32
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(df: DataFrame, held: int = 400_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, several rows a term.

    df: lang, source, text. A task adds up about `held` terms before it sends them; each group also sends a null term.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                terms = [None, *(t.decode() for t in n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text"))):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                words = text.encode("utf-8", "replace").translate(_TERMS).split()
                before = len(n)
                n.update(words)
                docs.update(set(words))
                size += len(n) - before
                if size > held:
                    yield from sent()
                    size = 0
        yield from sent()

    return df.select("lang", "source", "text").mapInArrow(counted, _COUNTS)


def share(count: int, total: int, terms: int) -> int:
    """A term's share in billionths, from its count, all counts and the number of kept terms; exact."""
    return 1 + _SCALE * (count + 1) // (total + terms) if total + terms else 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), exact: shares are at most 10^9 + 1."""
    d = p - q
    return d * d // q


class Levels:
    """A group's terms of one chunk by count: bitmaps of the levels with many terms, numbers of the others."""

    def __init__(self, term: np.ndarray, count: np.ndarray, total: int, terms: int, width: int):
        values, level = np.unique(count, return_inverse=True)
        self.p = np.array([share(int(c), total, terms) for c in values], dtype=np.int64)
        self.none = np.int64(share(0, total, terms))
        self.of = np.full(width, self.none, dtype=np.int64)
        self.of[term] = self.p[level]
        dense = np.flatnonzero(np.bincount(level, minlength=len(values)) >= _SPARSE)
        bits = np.zeros((len(dense) + 2, -(-width // 64) * 64), dtype=bool)
        for row, k in enumerate(dense):
            bits[row, term[level == k]] = True
        bits[-2, term[~np.isin(level, dense)]] = True
        bits[-1, term] = True
        packed = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        self.dense, self.bitmaps, self.sparse, self.any = self.p[dense], packed[:-2], packed[-2], packed[-1]


def joint_sum(a: Levels, b: Levels) -> tuple[int, int]:
    """Over terms that both have: how much more their divergence is than if only one had them (a from b, b from a).

    That is f(a, b) - f(a, 0) - f(0, b) + f(0, 0), so that terms that one or both lack can be added by level alone.
    """

    def more(p: np.ndarray, q: np.ndarray, p0: np.int64, q0: np.int64) -> np.ndarray:
        return divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)

    out = [0, 0]
    if len(a.dense) and len(b.dense):
        cells = np.bitwise_count(a.bitmaps[:, None, :] & b.bitmaps[None, :, :]).sum(axis=2, dtype=np.int64)
        p, q = a.dense[:, None], b.dense[None, :]
        out[0] += int((cells * more(p, q, a.none, b.none)).sum())
        out[1] += int((cells * more(q, p, b.none, a.none)).sum())
    apart = (a.sparse & b.any) | (a.any & b.sparse)
    if apart.any():
        at = np.flatnonzero(np.unpackbits(apart.view(np.uint8), bitorder="little"))
        p, q = a.of[at], b.of[at]
        out[0] += int(more(p, q, a.none, b.none).sum())
        out[1] += int(more(q, p, b.none, a.none).sum())
    return out[0], out[1]


_PAIRS = "lang string, source string, item string, value bigint"
_PAIR = [c.split()[0] for c in _PAIRS.split(", ")]


def _cells(group: pd.DataFrame) -> pd.DataFrame:
    """Joint sums of the pairs of sources of one chunk of terms and one pair of tiles."""
    a, b = int(group["tile_a"].iloc[0]), int(group["tile_b"].iloc[0])
    terms, names = pd.factorize(group["term"])
    tiles: dict[int, dict[str, Levels]] = {a: {}, b: {}}
    for source, rows in group.assign(term=terms).groupby("source", sort=True):
        found = Levels(rows["term"].to_numpy(), rows["n"].to_numpy(), int(rows["total"].iloc[0]), int(rows["terms"].iloc[0]), len(names))
        tiles[int(rows["tile"].iloc[0])][source] = found
    lang, out = group["lang"].iloc[0], []
    for x, left in tiles[a].items():
        for y, right in tiles[b].items():
            if a != b or x < y:
                one, other = joint_sum(left, right)
                out += [(lang, x, y, one), (lang, y, x, other)]
    return pd.DataFrame(out, columns=_PAIR)


def _margins(group: pd.DataFrame) -> pd.DataFrame:
    """For each pair of sources of a pair of tiles: the divergence if no term were in both, from the sizes of levels."""
    a, b = int(group["tile_a"].iloc[0]), int(group["tile_b"].iloc[0])
    terms = int(group["terms"].iloc[0])
    levels: dict[int, dict[str, tuple]] = {a: {}, b: {}}
    for source, rows in group.groupby("source", sort=True):
        total = int(rows["total"].iloc[0])
        shares = np.array([share(int(c), total, terms) for c in rows["n"]], dtype=np.int64)
        levels[int(rows["tile"].iloc[0])][source] = (shares, rows["size"].to_numpy(np.int64), np.int64(share(0, total, terms)))
    lang, out = group["lang"].iloc[0], []
    for x, (p, n, p0) in levels[a].items():
        for y, (q, m, q0) in levels[b].items():
            if a != b or x < y:
                for i, j, u, un, u0, v, vn, v0 in ((x, y, p, n, p0, q, m, q0), (y, x, q, m, q0, p, n, p0)):
                    none = divergence(u0, v0)
                    value = (un * (divergence(u, v0) - none)).sum() + (vn * (divergence(u0, v) - none)).sum() + terms * none
                    out.append((lang, i, j, int(value)))
    return pd.DataFrame(out, columns=_PAIR)


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, top_terms: int = 200, chunk_terms: int = 4096, tile_rows: int = 1 << 18) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms.

    Part `pair` has a row for each other source of the language, part `term` the top_terms kept terms that the source
    has more of than the language. A language keeps the terms of least_docs of its documents or more. All numbers are
    exact while a language keeps fewer than 10^9 terms. Null texts, languages and sources are empty ones; repeated rows
    count; groups without terms have pair rows, too; a language of one source has none; an empty table gives an empty
    result; other columns are neither read nor returned.

    Terms are dealt by hash into chunks of about chunk_terms, and sources of a chunk into tiles of tile_rows, so a task
    compares a bounded part whatever the language's share. A pair of sources is a row of the result, so work and rows
    grow with the square of a language's sources.
    """
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    # One shuffle by (lang, term) serves the sums, the documents of a term over all sources, and its first row.
    dealt = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = dealt.withColumns({"all_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "one": F.row_number().over(of_term.orderBy("source")) == 1})
    kept = written(kept.where(F.col("term").isNull() | (F.col("all_docs") >= least_docs)).drop("docs", "all_docs"), "terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("one") & F.col("term").isNotNull()).alias("terms"))
    groups = written(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(perhaps_broadcast(written(langs, "langs")), "lang"), "groups")
    rows = kept.where("term IS NOT NULL").join(perhaps_broadcast(groups), ["lang", "source"])

    per = "1 + CAST(CAST(1000000000 AS DECIMAL(10,0)) * CAST({} + 1 AS DECIMAL(20,0)) div CAST({} + terms AS DECIMAL(20,0)) AS BIGINT)"
    told = rows.withColumns({"p": F.expr(per.format("n", "total")), "q": F.expr(per.format("lang_n", "lang_total"))}).where("p > q")
    told = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    chunk = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / chunk_terms)).cast("int")
    cells = rows.select("lang", "source", "term", "n", "total", "terms", chunk.alias("chunk"))
    joint = tiled(cells, ["lang", "chunk"], "source", tile_rows).groupBy("lang", "chunk", "tile_a", "tile_b").applyInPandas(_cells, _PAIRS)
    levels = rows.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("size"))
    levels = levels.unionByName(groups.select("lang", "source", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("size")))
    levels = levels.join(perhaps_broadcast(groups.select("lang", "source", "total", "terms")), ["lang", "source"])
    margins = tiled(levels, ["lang"], "source", tile_rows).groupBy("lang", "tile_a", "tile_b").applyInPandas(_margins, _PAIRS)
    pairs = joint.unionByName(margins).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("bigint").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # The limit on ranks is met within tasks before rows are shuffled.
    out = pairs.withColumn("rank", ranks).unionByName(told.withColumn("rank", ranks).where(F.col("rank") <= top_terms))
    return out.select("lang", "source", "part", "item", "value", "rank")
