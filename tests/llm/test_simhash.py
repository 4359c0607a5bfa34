import numpy as np
import xxhash
from pyspark.sql import functions as F

from epochflow.llm import simhash
from epochflow.llm.queries import op5_simhash_near_dedup


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))]


def test_bit_sliced_distances_match_plain_ones():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    rows = np.array([base[k % 5] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k % 9, replace=False))) for k in range(300)], dtype=np.uint64)
    for radius in (0, 1, 3, 4, 7, 8):
        got = {q: set(r.tolist()) for q, r in simhash.near(rows, rows, radius)}
        for q in range(300):
            assert got[q] == {r for r in range(300) if (int(rows[q]) ^ int(rows[r])).bit_count() <= radius}


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [brute_fingerprint(d.text) for d in docs]
    want = {d.doc_id: (f"{p:016x}", c) for d, p, c in zip(docs, prints, brute_components([d.doc_id for d in docs], prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash_near_dedup(spark, sf_dir).collect()} == want


def test_small_cells_and_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique([centres[k % 40] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k % 7, replace=False))) for k in range(600)])
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    want = brute_components([int(p) for p in prints.view(np.int64)], [int(p) for p in prints])
    for cell in (4, 64, 4096):
        got = dict(simhash.link_fingerprints(df, "fp", 4, cell).collect())
        assert [got.get(int(p), int(p)) for p in prints.view(np.int64)] == want


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 1), (4, " \n", 2), (None, "a b c d e f", 3), (9, "A b c d E f", 3), (9, "A b c d E f", 3), (None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(simhash.near_duplicates(df).collect(), key=str)
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 3), (0, 9), (3, 3), (4, 3), (5, 3), (9, 9), (9, 9)]
    for odd in (df, df.withColumnRenamed("fp", "_key0").withColumn("node", F.lit(1))):
        kept = simhash.keep_one(odd).collect()
        assert sorted(r.doc_id for r in kept) == [3, 9] and list(kept[0].asDict()) == odd.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "x y z")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_duplicates(alone).collect()] == [None]
    assert simhash.keep_one(alone).count() == 1 and simhash.keep_one(alone.limit(0)).count() == 0


def jaccard_components(docs, similarity=0.8):
    """Smallest id that each document reaches by pairs of that Jaccard similarity of five-word shingles."""
    def grams(text):
        words = (text or "").lower().split()
        return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}

    sets = {i: grams(t) for i, t in docs}
    holders, root = {}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        shared = {}
        for g in s:
            for j in holders.get(g, ()):
                shared[j] = shared.get(j, 0) + 1
            holders.setdefault(g, []).append(i)
        for j, n in shared.items():
            if n >= similarity * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_copies_at_a_similarity_of_08_are_one_group(spark):
    """Planted copies at 0.8 to 0.95, and others just below: exactly one of each group stays."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]
    docs, n = [], 0
    for group in range(60):
        base = [words[i] for i in rng.integers(0, 5000, 120 + 5 * group)]
        for changed in (0, 1, 2, 3, 4, 6, 9):
            text = list(base)
            for at in rng.choice(len(base) // 8, changed * len(base) // 200 + (changed > 0), replace=False) * 8:
                text[at] = f"x{rng.integers(0, 10**6)}"
            docs.append((n, " ".join(text)))
            n += 1
    docs += [(n + i, f"short text {i % 9}") for i in range(30)]
    want = jaccard_components(docs)
    assert 61 < len(set(want.values())) < 300
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(want.values()))


def test_large_groups_are_tiled(spark):
    """One large group of distinct near copies, cut into many tiles: nothing is lost and one stays."""
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join([*base[:50], f"x{i}", *base[51:]])) for i in range(300)] + [(300 + i, f"other text number {i} of its own") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints, texts = small_prints(df), df.select(F.col("doc_id").alias("k"), "text")
    got = dict(simhash.link_similar(prints, texts, "k", 0.8, 5, 20, cell_rows=16, compare_rows=16).collect())
    assert len(got) == 299 and len(set(got.values())) == 1  # all but the component itself


def small_prints(df):
    rows = []
    for r in df.collect():
        h = simhash.shingle_hashes(r.text, 5)
        rows.append((r.doc_id, int(np.uint64(simhash.majority(h)).astype(np.int64)), len(h), simhash.band_keys(h, 16, 4).tolist(), r.doc_id))
    return df.sparkSession.createDataFrame(rows, "node long, fp long, n_shingles int, keys array<long>, k long")


def test_runs_and_pairs_match_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(1, 400))
        key, tile = np.sort(rng.integers(0, 6, n)), np.zeros(n, dtype=int)
        a, b = (0, 0) if rng.random() < 0.5 else (1, 2)
        if b:
            tile = rng.integers(1, 3, n)
        order = np.lexsort((tile, key))
        key, tile = key[order], tile[order]
        prints = rng.integers(0, 2**63, n, dtype=np.uint64) & np.uint64(0xFFFFF)
        low, high = simhash.runs(key, tile, a, b)
        got = {(int(i), int(j)) for x, y in simhash.near_in_runs(prints, low, high, 6, block=7) for i, j in zip(x, y)}
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and (tile[i] != tile[j]) == (a != b) and (int(prints[i]) ^ int(prints[j])).bit_count() <= 6}
        assert got == want
