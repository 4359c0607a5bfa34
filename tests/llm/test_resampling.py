import hashlib
import math
import re
import zlib

import pyarrow as pa

from epochflow.llm import resampling

ODD = [(1, None, "x"), (2, "", "x"), (None, "a b", "y"), (3, "A a\tB-b ß9 \x00 ÄÖ ä", None), (3, "A a\tB-b ß9 \x00 ÄÖ ä", None), (4, " ... ", "z"), (5, "w " * 30_000, "z"), (6, "the cat sat on the mat " * 5, "z"), (7, "dog " * 20, "z")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def grams(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, n, buckets, percent, least, seed):
    def count(texts):
        out = [0] * buckets
        for t in texts:
            for g in grams(t, n)[1]:
                out[zlib.crc32(g.encode()) % buckets] += 1
        return out

    s, t = count(r[1] for r in rows), count(target)
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (big_s + buckets) / ((a + 1) * (big_t + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, (doc, text, *_) in enumerate(rows):
        words, f = grams(text, n)
        w = sum(gain[zlib.crc32(g.encode()) % buckets] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_features_of_odd_texts_and_orders():
    texts = [r[1] for r in ODD]
    for n in (1, 2, 3):
        words, owner, bucket = resampling.hashed_ngrams(pa.array(texts, pa.string()), n, 997)
        for i, t in enumerate(texts):
            w, f = grams(t, n)
            assert words[i] == len(w)
            assert sorted(bucket[owner == i].tolist()) == sorted(zlib.crc32(g.encode()) % 997 for g in f)


def test_draw_against_brute_force(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    target = spark.createDataFrame([("The cat.",), (None,), ("cat mat",)], "text string")
    for n, percent in ((1, 50), (2, 100), (3, 34)):
        got = resampling.draw(docs, target, n=n, buckets=101, percent=percent, least_words=2, seed=7)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(ODD, ["The cat.", None, "cat mat"], n, 101, percent, 2, 7)


def test_target_like_documents_are_drawn_and_columns_stay(spark):
    rows = [(i, ("gold silver " if i % 10 == 0 else "lead iron ") * 15, i % 3) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    target = spark.createDataFrame([("gold silver " * 50,)], "text string")
    got = resampling.resampled(docs, target).collect()
    assert len(got) == 40 and sum(r.doc_id % 10 == 0 for r in got) >= 35  # a draw: noise may prefer a few others
    assert set(map(tuple, got)) <= set(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.draw(docs, some).count() == 0
    assert [tuple(r)[:2] for r in resampling.draw(some, docs, least_words=1, percent=100).collect()] == [(1, 3)]
