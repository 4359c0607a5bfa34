import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from epochflow.llm import substrings


def brute(texts, window):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), [x for j, x in enumerate(w) if j not in gone]))
    return out


def made(seed, docs=60):
    """Few words, so that short runs repeat everywhere; passages, copies, copies with a change, runs of one word."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["aa", "b", "Cc", "ü", "d.", "e", "f", "gg"])
    passages = [[word() for _ in range(rng.randint(5, 60))] for _ in range(5)]
    texts = []
    for _ in range(docs):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice([rng.choice(passages), [word() for _ in range(rng.randint(0, 30))], ["x"] * rng.randint(0, 40)])
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += [texts[0], texts[1] + " z", "y " + texts[2], None, "", "  \n", texts[3].replace("b", "q", 1)]
    return texts


@pytest.mark.parametrize("seed,window,gram,most,group_rows", [(1, 35, 8, 20_000, 10_000), (2, 12, 4, 2, 5), (3, 7, 7, 1, 3), (4, 9, 2, 3, 1000), (5, 1, 8, 2, 10), (6, 2, 1, 2, 7)])
def test_against_brute_force(spark, seed, window, gram, most, group_rows):
    texts = made(seed)
    df = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(5)
    got = substrings.removed(df, window=window, gram=gram, most=most, group_rows=group_rows)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = sorted((i % 50, n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, (n, gone, kept) in enumerate(brute(texts, window)))
    assert sorted(map(tuple, got.collect())) == want


def test_tree_orders_suffixes_and_measures_what_they_share():
    rng = np.random.default_rng(1)
    for depth in (1, 2, 5, 8, 35):
        symbols = rng.integers(0, 2, 400)
        starts = np.sort(rng.choice(400 - depth, 150, replace=False))
        order, shared = substrings.tree(symbols, starts, depth)
        cut = [tuple(symbols[s : s + depth]) for s in order]
        assert sorted(order.tolist()) == starts.tolist() and cut == sorted(cut)
        for (a, b), n in zip(zip(cut, cut[1:]), shared[1:]):
            assert n == next((k for k in range(depth) if a[k] != b[k]), depth)


def test_pieces_of_long_texts_join(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_PIECE_BYTES", 50)
    monkeypatch.setattr(substrings, "_STREAM_WORDS", 40)
    rng = random.Random(5)
    passage = " ".join(str(rng.random()) for _ in range(60))
    texts = [" ".join(str(rng.random()) for _ in range(100)) + " " + passage + " end " + "w" * 500, passage + " x", "v " * 300]
    want = brute(texts, 35)
    for text, (n, gone, kept) in zip(texts, want):
        pieces = list(substrings._pieces(text.encode()))
        assert [w.decode() for p in pieces for w in p] == text.split() and len(pieces) > 1
        assert n == len(text.split()) and n - gone == len(kept)
    starts, ends = np.array([0, 3, 40]), np.array([2, 30, 55])
    covered = {j for a, b in zip(starts, ends) for j in range(a, b)}
    got = [w.decode() for _, keep in substrings._kept(texts[0], starts, ends) for w in keep]
    assert got == [w for j, w in enumerate(texts[0].split()) if j not in covered]


def test_a_million_words_and_an_empty_table(spark):
    rng = np.random.default_rng(3)
    long = " ".join(map(str, rng.integers(0, 1 << 40, 700_000))) + " tail" * 300_000
    piece = " ".join(long.split()[500_000:500_100])
    df = spark.createDataFrame([(1, long), (2, "before " + piece)], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.removed(df).collect()}
    assert (got[1].n_words, got[1].n_removed) == (1_000_000, 300_100)
    assert (got[2].n_words, got[2].n_removed, got[2].kept_sha256) == (101, 100, hashlib.sha256(b"before").hexdigest())
    assert substrings.removed(df.limit(0)).count() == 0


def test_texts_lose_repeats_and_keep_other_columns(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"one {passage} two", "k"), (2, f"{passage}  three", None), (3, "left  as it is", "k"), (None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lo string")
    got = {tuple(r) for r in substrings.without_repeats(df).collect()}
    assert got == {(1, "one two", "k"), (2, "three", None), (3, "left  as it is", "k"), (None, None, "k")}
