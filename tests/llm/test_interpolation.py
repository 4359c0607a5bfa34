import math
import zlib
from collections import Counter

import numpy as np
import pytest

from epochflow.llm import interpolation
from epochflow.llm.common import words_of


def brute_base(rows):
    train = [words_of(t) + [None] for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        ws = words_of(t) + [None]
        out.append((i, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)))
    return out


def check(rows, got):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    want = sorted(brute_base(rows), key=key)
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [w[:4] for w in want] == [h[:4] for h in have]
    assert np.allclose([w[4] for w in want], [h[4] for h in have], rtol=1e-9)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    assert all(r.score < 0 for r in got)


def test_query_against_brute_force(spark, sf_dir):
    from epochflow.llm.queries import op6_lm_scores

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = op6_lm_scores(spark, sf_dir).collect()
    check([(d.doc_id, d.text) for d in docs], got)
    apart = [r for r in got if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)


def test_many_blocks_give_the_same_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    one = {r.doc_id: r for r in interpolation.scores(docs).collect()}
    for r in interpolation.scores(docs.repartition(3), block_tokens=500, bucket_chars=5000).collect():
        assert r.score == pytest.approx(one[r.doc_id].score, rel=1e-9) and r.n_known == one[r.doc_id].n_known


def test_scores_are_probabilities(spark):
    """With one context, the model's probabilities of all tokens and the unknown add up to one."""
    rows = [(i, "a b a c a b") for i in range(40)]
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(["a", "b", "c", "z", ""])], "doc_id long, text string")
    train = docs.where("doc_id < 1000")
    assert train.count() == 40
    got = {r.doc_id: r for r in interpolation.scores(docs).collect()}
    assert got[3].score > got[3].base_score
    assert got[1003].score < got[1000].score


def test_weights_follow_the_held_out_counts():
    table = [(3, -10, -20, 900), (3, -9999, -20, 100), (5, -9999, -9999, 50)]
    w = interpolation.fit_weights(table, 0.001)
    assert w[3][0] > 0.85 and sum(w[3]) == pytest.approx(1) and w[5][2] > 0.9


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A a\tb"), (3, "A a\tb"), (None, "x y"), (4, "q " * 3000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, score string")
    check(rows, interpolation.scores(df).collect())
    assert interpolation.scores(df.limit(0)).count() == 0
    apart = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = interpolation.scores(spark.createDataFrame([(apart, "x")], "doc_id long, text string")).collect()
    assert alone[0].train_tokens == 0 and alone[0].n_known == 0 and alone[0].score == 0.0
