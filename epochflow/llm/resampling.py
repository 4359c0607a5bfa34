"""Importance resampling: documents are drawn so that their hashed n-grams come near those of a target text.

Texts become features in Arrow kernels (ascii_lower, split_pattern_regex, list_flatten, dictionary_encode); n-grams are
runs of dictionary indices, and a CRC is taken once for each distinct one of a batch. A bucket's gain is the log of its
share in the target over that in the corpus; a document weighs the mean of its features' gains, and seeded Gumbel noise
on top of it makes the highest scores a draw without replacement in proportion to those weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of text that go through the kernels at a time (a longer text goes alone).
_PART_CHARS = 4_000_000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts hold about _PART_CHARS bytes."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(sizes // _PART_CHARS)) + 1 if len(sizes) else []
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if end > start:
                yield batch.slice(start, end - start)


def hashed_ngrams(texts: pa.Array, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature), features in the order of their texts."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), _BETWEEN)
    owner, flat = pc.list_parent_indices(split), pc.list_flatten(split)
    real = pc.not_equal(pc.binary_length(flat), 0)
    owner, coded = pc.filter(owner, real).to_numpy().astype(np.int64), pc.filter(flat, real).dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    code, crc = index, np.array([zlib.crc32(w) for w in words], dtype=np.int64)
    found_owner, found = [owner], [np.take(crc, code) % buckets]
    for order in range(1, n):
        # A longer run is a distinct run of one word less, and the word that many places on.
        whole = owner[: len(owner) - order] == owner[order:]
        distinct, inverse = np.unique((code[: len(whole)] * max(len(words), 1) + index[order:])[whole], return_inverse=True)
        crc = np.array([zlib.crc32(b" " + words[pair % len(words)], int(crc[pair // len(words)])) for pair in distinct], dtype=np.int64)
        code = np.full(len(whole), -1, dtype=np.int64)
        code[whole] = inverse
        found_owner.append(owner[: len(whole)][whole])
        found.append(np.take(crc, inverse) % buckets if len(crc) else np.zeros(0, dtype=np.int64))
    owner_of, bucket = np.concatenate(found_owner), np.concatenate(found)
    if n > 1:
        in_order = np.argsort(owner_of, kind="stable")
        owner_of, bucket = owner_of[in_order], bucket[in_order]
    return np.bincount(owner, minlength=len(texts)), owner_of, bucket


def features(df: DataFrame, text: str, n: int, buckets: int, *keep: Column) -> DataFrame:
    """Columns of `keep` and n_words, buckets (one entry a feature)."""
    source = df.select(*keep, F.col(text).alias("text"))
    kept = source.drop("text").schema

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            words, owner, bucket = hashed_ngrams(part["text"].cast(pa.string()), n, buckets)
            ends = np.append(0, np.cumsum(np.bincount(owner, minlength=part.num_rows)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[part[c] for c in kept.names], pa.array(words, pa.int64()), lists], names=[*kept.names, "n_words", "buckets"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return source.mapInArrow(made, ", ".join(x for x in (fields, "n_words bigint, buckets array<int>") if x))


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features of each bucket: a task sends one row for each bucket that it has, `buckets` rows come back at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(pc.list_flatten(batch["buckets"]).to_numpy(zero_copy_only=False), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.select("buckets").mapInArrow(counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of a bucket's share in the target over that in the corpus), one added to each count."""
    s, t, k = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(scale * math.log((float(b) + 1) * (s + k) / ((float(a) + 1) * (t + k)))) for a, b in zip(corpus, target)], dtype=np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """rows of features() with n_features and weight (the floored mean of the features' gains; none: 0), without buckets."""
    sent = rows.sparkSession.sparkContext.broadcast(gain)  # as many numbers as there are buckets
    kept = rows.drop("buckets").schema

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["buckets"]
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.append(np.take(sent.value, pc.list_flatten(lists).to_numpy(zero_copy_only=False)), 0)
            ends = np.cumsum(sizes)
            sums = np.where(sizes > 0, np.add.reduceat(values, ends - sizes), 0) if len(sizes) else sizes
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept.names], pa.array(sizes, pa.int64()), pa.array(sums // np.maximum(sizes, 1), pa.int64())], names=[*kept.names, "n_features", "weight"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(weighed, f"{fields}, n_features bigint, weight bigint")


def _noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) of a seeded hash of the id, u strictly between 0 and 1; a null id hashes as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.ln(-F.ln(u))).cast("bigint")


def _ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """Adds rank (1 for the highest score, ties to the smaller id) to `percent` of the eligible rows, null to the others.

    Scores are whole numbers between -210,000 and 210,000 (gains are at most 1000 * 2 * ln(2^63 * 2), noise at most
    22,200), so their counts fit on the driver, and the places of a score begin where those of higher ones end. Rows
    of one score are ordered in a task: noise spreads different ids, whatever their weights, so that a score has no
    more than about one row of 2,700.
    """
    counts = dict(scored.where(eligible).groupBy("score").agg(F.count(F.lit(1))).collect())
    drawn = percent * sum(counts.values()) // 100
    before, places = 0, []
    for score in sorted(counts, reverse=True):
        if before >= drawn:
            break
        places.append((score, before))
        before += counts[score]
    spark = scored.sparkSession
    cut = places[-1][0] if places else None
    high = eligible & (F.col("score") >= F.lit(cut)) if places else F.lit(False)
    place = F.broadcast(spark.createDataFrame(places, "score bigint, _before bigint"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("_id").asc_nulls_last(), "weight", "n_features"))
    top = scored.where(high).join(place, "score").withColumn("rank", at).drop("_before")
    return top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("bigint")))


def draw(
    df: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """One row per input row: id_col, n_features, weight, score, rank (null where not drawn), all bigint.

    Features are runs of 1 to n words. Drawn are `percent` of the documents with least_words words or more, those of the
    highest scores. Null and empty texts have no features, weight 0 and no rank; a null id is scored as an empty one and
    comes last among ties; repeated rows stay and are drawn apart; an empty table gives an empty result, and an empty
    target gives gains that only even out the corpus. Other columns are neither read nor returned.
    """
    scored = _scored(df, target, n, buckets, seed, id_col, text, target_text)
    out = _ranked(scored, F.col("n_words") >= least_words, percent)
    return out.select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")


def _scored(df: DataFrame, target: DataFrame, n: int, buckets: int, seed: int, id_col: str, text: str, target_text: str) -> DataFrame:
    rows = written(features(df, text, n, buckets, F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text).alias("_body")), "features")
    gain = gains(bucket_counts(rows, buckets), bucket_counts(features(target, target_text, n, buckets), buckets))
    return written(weighted(rows, gain).withColumn("score", F.col("weight") + _noise(F.col("_id"), seed)), "scores")


def resampled(
    df: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """The drawn rows of df with all their columns; rows of equal id and text are drawn together. See draw()."""
    ranked = _ranked(_scored(df, target, n, buckets, seed, id_col, text, target_text), F.col("n_words") >= least_words, percent)
    picked = ranked.where("rank IS NOT NULL").select("_id", F.col("_body").alias("_picked")).distinct()
    same = df[id_col].cast("bigint").eqNullSafe(picked["_id"]) & (F.xxhash64(df[text]) == picked["_picked"])
    return df.join(picked, same, "left_semi")
