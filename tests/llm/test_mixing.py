import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochflow.llm import mixing
from epochflow.llm.queries import op1_mix_sources


def brute_targets(sizes, weights, total, most=2):
    """Raises a common level until the capped shares use up the total."""
    low, high = 0.0, 1e12
    for _ in range(400):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * s, w * mid) for s, w in zip(sizes, weights)) < total else (low, mid)
    return [min(most * s, w * low) for s, w in zip(sizes, weights)]


def test_targets_match_water_filling(spark):
    rng = np.random.default_rng(0)
    for n in (1, 5, 9, 40):
        sizes = rng.integers(0, 1000, n).tolist()
        weights = [(5, 2, 1)[i % 3] for i in range(n)]
        df = spark.createDataFrame([(f"s{i:02d}" if i < n - 1 else None, s) for i, s in enumerate(sizes)], "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.reshared(df, (5.0, 2.0, 1.0), 1.5, 2).collect()}
        want = brute_targets(sizes, weights, 1.5 * sum(sizes))
        assert [got[f"s{i:02d}" if i < n - 1 else None] for i in range(n)] == pytest.approx(want, rel=1e-9)
    got = {r.source: r.target for r in mixing.reshared(df, {"s01": 1, None: 3}, 0.001, 2).collect()}
    assert got[None] == pytest.approx(3 * got["s01"]) and sum(v > 0 for v in got.values()) == 2


def test_quotas_are_exact():
    quotas = np.array([100, 37, 1, 0])
    for weights in ([1] * 7, [3, 1, 1, 2]):
        parts = mixing.split_quotas(quotas, np.array(weights), np.random.default_rng(1))
        assert parts.shape == (len(weights), 4) and (parts.sum(axis=0) == quotas).all() and parts.min() >= 0
        assert all(abs(p - 138 * w / sum(weights)) <= 3 for p, w in zip(parts.sum(axis=1), weights))


def test_many_sources_and_levels(spark):
    """More sources than groups, and more shards than branches: targets and draws stay exact, and shards even."""
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5000}" if i % 3 else "hot") for i in range(12000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken_words(df, shards=64, groups=16, branches=8).collect()
    check(got)
    draws = [s for r in got for s in r.shards]
    assert set(draws) == set(range(64))
    again = mixing.taken_words(df.repartition(7), shards=64, groups=16, branches=8).collect()
    assert {(r.doc_id, r.taken, tuple(r.shards)) for r in again} == {(r.doc_id, r.taken, tuple(r.shards)) for r in got}


def check(rows):
    by = {}
    for r in rows:
        r = r if isinstance(r, dict) else r.asDict()
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["shards"]) <= 2
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    want = brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes))
    for s, n, t in zip(names, sizes, want):
        assert {(r["source_size"], round(r["target"], 4)) for r in by[s]} == {(n, round(t, 4))}
        assert sum(r["taken"] for r in by[s]) == round(by[s][0]["target"])


def test_query(spark, sf_dir):
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    first = mixing.taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) for r in first)
    check(first)
    again = op1_mix_sources(spark, sf_dir).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in first}


def test_mix_holds_what_was_planned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs, shards=5).collect()}
    out = mixing.mixed(docs, shards=5).collect()
    got = {}
    for r in out:
        assert len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) == r.mix_words
        got[r.doc_id] = got.get(r.doc_id, 0) + r.mix_words
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v}
    assert {r.mix_shard for r in out} == set(range(5))


def test_odd_rows(spark):
    rows = [(1, "a b c", None, 1), (1, "a b c", None, 1), (2, None, None, 2), (None, "x y", "s", 3), (3, "", "s", 4), (4, "q\tr " * 50, "t", 5), (5, "w", "u", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = mixing.taken_words(df).collect()
    assert len(got) == 7 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sum(r.taken for r in got) <= 1.5 * sum(r["size"] for r in got) + 4
    assert set(mixing.mixed(df).columns) == {"doc_id", "text", "source", "size", "mix_shard", "mix_words"}
    assert mixing.taken_words(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert mixing.taken_words(df.where("doc_id = 2")).first().taken == 0


def test_a_dominant_source_has_blocks_by_its_size(spark):
    """One source of 90 % of the words among 5,000 others: blocks stay near one eighth of a shard, and totals exact."""
    rows = spark.range(45_000).selectExpr("id AS doc_id", "repeat('w ', 20) AS text", "'big' AS source").union(spark.range(5_000).selectExpr("id + 100000 AS doc_id", "repeat('w ', 20) AS text", "concat('s', id) AS source"))
    mix = mixing.plan_mix(rows, shards=200)
    largest = mix.sizes.groupBy("source", "block").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0]
    assert mix.many.collect() == [("big", 1440)] and largest <= 4 * 20 * 45_000 // 1440
    taken = mixing.taken_words(rows, shards=200).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
    assert len(taken) == 5001 and all(r.n == round(r.t) for r in taken)
