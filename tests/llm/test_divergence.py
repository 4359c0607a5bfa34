import random
import re
from collections import Counter, defaultdict

import numpy as np

from epochflow.llm import divergence


def brute(rows, least=3, top=200):
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for t, l, s in rows]
    seen, n, langs = Counter(), Counter(), defaultdict(set)
    for lang, source, words in docs:
        langs[lang].add(source)
        seen.update((lang, w) for w in set(words))
        n.update((lang, source, w) for w in words)
    out = []
    for lang, sources in langs.items():
        kept = [w for (l, w), k in seen.items() if l == lang and k >= least]
        v = len(kept)

        def shares(of):
            total = sum(of)
            return [1 + 10**9 * (c + 1) // (total + v) for c in of]

        p = {s: shares([n[lang, s, w] for w in kept]) for s in sources}
        q = shares([sum(n[lang, s, w] for s in sources) for w in kept])
        for s in sources:
            pairs = sorted((-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -x, i) for i, (x, _, o) in enumerate(pairs, 1)]
            terms = sorted((-((a - b) ** 2 // b), w.encode(), w) for w, a, b in zip(kept, p[s], q) if n[lang, s, w] and a > b)
            out += [(lang, s, "term", w, -x, i) for i, (x, _, w) in enumerate(terms[:top], 1)]
    return sorted(out)


def corpus(sources, docs, words, seed):
    rng = random.Random(seed)
    vocab = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'é' * (i // 676)}" for i in range(words)]
    return [(" ".join(rng.choices(vocab, [1 / (1 + (i + k) % words) for i in range(words)], k=rng.randint(0, 60))), rng.choice(["en", "de"]), f"s{k}") for k in (min(int(rng.expovariate(0.5)), sources - 1) for _ in range(docs))]


def test_against_brute_force_with_small_chunks_and_tiles(spark):
    rows = corpus(7, 400, 300, 1) + [(None, None, None), ("", "xx", "empty"), ("Only Here", "xx", "one"), ("9 _ 8", "yy", "alone"), ("ZÄ zÄ Zä", None, "s1")] * 2
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, lang string, source string, rank int")
    want = brute(rows)
    for chunk, tile in ((4096, 1 << 18), (16, 1 << 18), (64, 40)):
        assert sorted(map(tuple, divergence.audit(df, chunk_terms=chunk, tile_rows=tile).collect())) == want
    assert sorted(map(tuple, divergence.audit(df, least_docs=1, top_terms=3).collect())) == brute(rows, 1, 3)


def test_levels_by_bitmaps_and_by_numbers_agree():
    rng = np.random.default_rng(2)
    for width in (1, 63, 64, 65, 1000):
        counts = [rng.zipf(1.5, width) % 50 * (rng.random(width) < 0.7) for _ in range(2)]
        made = [divergence.Levels(np.flatnonzero(c), c[c > 0], int(c.sum()), 1500, width) for c in counts]
        p, q = (np.array([divergence.share(int(k), int(c.sum()), 1500) for k in c]) for c in counts)
        both = (counts[0] > 0) & (counts[1] > 0)
        f, (p0, q0) = divergence.divergence, (made[0].none, made[1].none)
        want = [int((f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0))[both].sum()) for x, y, x0, y0 in ((p, q, p0, q0), (q, p, q0, p0))]
        assert list(divergence.joint_sum(*made)) == want


def test_empty_table_and_one_very_long_text(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    rows = [("a b " * 200_000, "en", "long"), ("a b c", "en", "x"), ("a c", "en", "y"), ("b c", "en", "y")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, schema)).collect())) == brute(rows)


def test_shares_are_exact_beyond_long():
    assert divergence.share(10**13, 3 * 10**13, 10**6) == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 10**6)
    assert divergence.share(0, 0, 0) == 1
