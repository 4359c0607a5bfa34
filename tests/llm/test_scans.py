import hashlib
import math
import random
import re
import zlib

from epochflow.llm import licences, secret_grammar, toxicity, wrappers
from epochflow.llm.queries import op3_html_main_text, op4_license_scan, op9_secret_scan, op10_toxicity


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


# Licences

def brute_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, k) for p, k in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in places}))


def test_licence_query_against_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in op4_license_scan(spark, sf_dir).collect()}
    for d in documents(spark, sf_dir):
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licences(d.text)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licence_places_and_expressions():
    for text in ("MIT license mit license", "the mit-License; MIT  license", "Mitt license mit licenses", "GNU General Public License general public license", "é mit license", None, ""):
        r = licences.scan_text(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licences(text)
    assert licences.evaluate("MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)") == ({"mit", "apache-2.0", "gpl-2.0-only", "classpath-exception-2.0"}, 1.0)
    assert licences.evaluate("MIT AND Foo-1.0 OR") == ({"mit", "foo-1.0"}, 0.5)
    assert licences.evaluate("MIT OR (Apache-2.0 AND") == ({"mit"}, 1.0)
    assert licences.evaluate("the moon") is None and licences.evaluate(") AND") is None
    r = licences.scan_text("// SPDX-License-Identifier: BSD-3-Clause OR ISC\n" + "x")
    assert r["labels"] == "bsd-3-clause,isc" and r["score"] > 0.8 and r["n_base"] == 0
    assert licences.scan_text("Licensed under the Apache License, Version 2.0.")["labels"] == "apache,apache-2.0"


def test_each_tag_and_whole_expressions_count():
    r = licences.scan_text("Code is licensed under MIT. The data are released under CC-BY-4.0 and docs available under GPL-3.0-only.")
    assert r["labels"] == "cc-by,cc-by-4.0,gpl-3.0-only,mit" and r["score"] > 0.99
    ids = [f"bsd-{i}-clause" for i in range(200)]
    for joint in (" OR ", " OR\n", " OR\n\n  ", "\n * OR ", "\r\n# OR "):
        assert licences.scan_text(f"SPDX-License-Identifier: ({joint.join(ids)}) AND ISC")["labels"] == ",".join(sorted([*ids, "isc"]))
    assert licences.scan_text("licensed under Apache-2.0\nOR MIT")["labels"] == "apache-2.0,mit"
    assert licences.scan_text("SPDX-License-Identifier: MIT\n\nWith Python-3 it runs")["labels"] == "mit"
    assert licences.scan_text("SPDX-License-Identifier: MIT OR\nSPDX-License-Identifier: ISC")["labels"] == "isc,mit"


def test_licence_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "MIT license", "b"), (2, "x " * 50000, "c"), (2, "x " * 50000, "c")], "doc_id long, text string, labels string")
    got = licences.scan(df).collect()
    assert [(r.n_words, r.n_base, r.first_word) for r in got] == [(0, 0, None), (2, 1, 0), (50000, 0, None), (50000, 0, None)]
    assert licences.scan(df.limit(0)).count() == 0


# Secrets

def brute_spans(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


SECRETS = ["password: hunter22", "API_KEY='abc+/=' apikey=12345", "tokeN  =\"" + "0a" * 20 + '"', "AKIA" + "A1" * 8 + " AKIASHORT", "ſecret=abcdefgh", "xx" + "deadbeef" * 3 + "G", "secret:secret:secret=abcdefg", "toKen=abcdef"]


def test_secret_query_against_brute_force(spark, sf_dir):
    docs = {d.doc_id: d.text or "" for d in documents(spark, sf_dir)}
    for r in op9_secret_scan(spark, sf_dir).collect():
        base = brute_spans(docs[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert {s for s in said.split(",") if s} <= set(r.spans.split(","))


def test_secret_patterns():
    for text in [*SECRETS, " ".join(SECRETS), "é" + SECRETS[2]]:
        assert [(a, b, k) for a, b, k, _ in secret_grammar.base_spans(text)[0]] == brute_spans(text)


def test_learned_formats_find_unlabelled_secrets(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f"some words token = \"{key(i)}\" and more words of-text2 http://www.example.com/a1/page") for i in range(60)]
    lost = key(999)[:31].upper()
    df = spark.createDataFrame([*rows, (100, f"here is {key(777)}"), (101, "nothing-but-ordinary-words2-in-here"), (102, None)], "doc_id long, text string")
    grammar = secret_grammar.learn(df)
    assert grammar.automata.keys() == {"assign", "hex"}
    assert all(a.logp(key(i)) is not None for a in grammar.automata.values() for i in range(60))
    assert grammar.likelihood(key(5000)) > 0.3 > grammar.likelihood("nothing-but-ordinary-words2-in-here")
    assert grammar.likelihood(lost) == float("-inf")
    out = {r.doc_id: r.text for r in secret_grammar.redact(df, grammar=grammar).collect()}
    assert out[100] == "here is [SECRET]" and out[102] is None and out[101] == "nothing-but-ordinary-words2-in-here"
    assert out[3].startswith("some words [SECRET]") and key(3) not in out[3]


def test_secrets_inside_runs_are_found(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest().upper()
    rows = [(i, f"some words token = \"{key(i)}\" and more words of-text2 http://www.example.com/a1/page") for i in range(60)]
    grammar = secret_grammar.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    lost, base = key(5000), "0a" * 15
    for around in ("KEY={}", "//host.com/x/{}", "a.b={}/rest", "{}=" + key(5001), "//h/name={}.", base + "/{}", "{}=" + base + "=" + key(5001)):
        text = around.format(lost)
        found = [text[a:b] for a, b, kind, _ in grammar.spans(text)[1] if kind == "format"]
        assert lost in found and found == [v for v in (lost, key(5001)) if v in text], text
    assert list(secret_grammar._tokens("A" * 20, 0, 20, [])) == [(0, 20)]
    assert grammar.spans("//www.example.com/ordinary/pages/of-text2/words")[1] == []


def test_corpus_statistics_come_from_all_texts(spark):
    tokens = [f"of{i}-ordinary-words-in-here" for i in range(2500)] + [f"{'Z' * (1 + i % 3)}{i}-ORDINARY-{'Q' * 9}" for i in range(500)]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(tokens)], "doc_id long, text string, toxic int")
    counts = {c: 20 for c in ("d", "x", "l", "X", "U", *"+/_.=-")}
    for c in "".join(tokens):
        counts[secret_grammar._CLASS_OF.get(c, c)] += 1
    got = secret_grammar.learn(df).ordinary["mixed"]
    assert got.keys() == counts.keys() and all(abs(math.exp(p) - counts[c] / sum(counts.values())) < 1e-9 for c, p in got.items())
    chars = toxicity.learn(df.select("doc_id", "text"), df.where("doc_id < 100").select("doc_id", "toxic")).chars
    assert chars.tri["^^q"] == 500 and chars.tri["^^w"] == 2500


def test_automata_merge_and_keep_the_language():
    import itertools

    strings = ["".join(p) for n in (2, 4, 6) for p in itertools.product("1a", repeat=n)]
    a = secret_grammar.infer(strings)
    assert len([s for s in a.next]) >= 1 and all(a.logp(s) is not None for s in strings)


def test_secret_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "a" * 100000, 3), (2, "a" * 100000, 3)], "doc_id long, text string, spans long")
    got = secret_grammar.scan(df).collect()
    assert [r.n_hex for r in got] == [0, 0, 1, 1] and got[0].spans == "" and got[2].spans == "hex:0:100000"
    assert secret_grammar.scan(df.limit(0)).count() == 0


# Toxicity

def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op10_toxicity(spark, sf).collect()]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    apart = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in apart) / len(apart) > 0.93
    assert not any(p and not y for p, y in apart)


def test_disguised_words_are_restored(spark):
    rng = random.Random(1)
    words = [a + b for a in ("ta", "re", "mo", "sil", "ven") for b in ("ra", "der", "ket", "lo", "nu", "pin", "gor")]
    rows = [(i, " ".join(rng.sample(words, 12) + (["idiot", "stupid", "moron"] if i % 3 == 0 else ["weather", "fine"]))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) toxic")
    model = toxicity.learn(docs, labels)
    for token in ("id1ot", "1d10t", "i.d.i.o.t", "idiiiot", "m0r0n", "stup!d", "$tupid", "m-o-r-o-n"):
        assert toxicity.restored_words(token, model.chars, {}) & {"idiot", "moron", "stupid"}, token
    odd = spark.createDataFrame([(1, "you 1d10t"), (2, "i d i o t"), (3, "fine weather"), (4, None), (None, "")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score(odd, model).collect()}
    assert got[1] > 0.5 and got[2] > 0.5 and got[3] < 0.5 and got[4] < 0.5 and got[None] == got[4]


def test_long_disguises_are_restored(spark):
    around = "you are such a worthless go away now please".split()
    rows = [(i, " ".join(around + (["idiot", "stupid"] if i % 3 == 0 else ["weather", "fine"]))) for i in range(150)]
    docs = spark.createDataFrame([(i, f"{t} {'abcdefghijklmnop'[i % 16]}{i}") for i, t in rows], "doc_id long, text string")
    model = toxicity.learn(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) toxic"))
    sentence = " ".join("youaresuchaworthlessidiotgoawaynowplease")
    texts = [sentence, " ".join([sentence] * 3), "a i d i o t", "i.........d.........i.........o.........t", "1--------d--------1--------0--------t--------", " ".join("youaresuchweathergoawaynowplease" * 2)]
    assert all(len(t) > 40 for t in texts if t != texts[2]) and len(texts[0]) < 80 < len(texts[1]) and len(texts[5]) > 80
    for t in texts[:5]:
        assert "idiot" in toxicity.restored_words(t, model.chars, {}), t
    assert {"you", "worthless", "idiot", "please"} <= toxicity.restored_words(sentence, model.chars, {})
    got = [r.toxicity > 0.5 for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert got == [True] * 5 + [False]


def test_viterbi_finds_the_best_of_all_paths():
    """All spellings of short tokens, scored one by one."""
    import itertools

    words = "toilet illegal idiot stupid little list still title".split()
    tri = {}
    for w in words:
        w = f"^^{w}$"
        for i in range(len(w) - 2):
            tri[w[i : i + 3]] = tri.get(w[i : i + 3], 0) + 1
    model = toxicity.CharModel(tri)

    def options(token, i):
        c = token[i]
        out = [(c, 0.0)] if c.isalpha() else []
        out += [(x, toxicity._LOOK) for x in toxicity.LOOKALIKES.get(c, "")]
        if not c.isalpha():
            out.append(("", toxicity._MARK if c in toxicity._MARKS else toxicity._SIGN))
        return out

    rng = random.Random(3)
    for _ in range(60):
        token = "".join(rng.choice("1|!ltio.50") for _ in range(rng.randrange(1, 8)))
        best = -1e9
        for path in itertools.product(*(options(token, i) for i in range(len(token)))):
            letters = "^^" + "".join(x for x, _ in path) + "$"
            best = max(best, sum(w for _, w in path) + sum(model.logp(*letters[i : i + 3]) for i in range(len(letters) - 2)))
        got = toxicity.restore(token, model)
        if not any(a == b and a.isalpha() for a, b in zip(token, token[1:])):
            letters = "^^" + got + "$"
            assert best - 1e-9 <= sum(model.logp(*letters[i : i + 3]) for i in range(len(letters) - 2)), token


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "x", 2), (2, "y " * 50000, 3), (2, "y " * 50000, 3)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.scan(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scan(docs.limit(0), labels.limit(0)).count() == 0


# Pages

def test_pages_query_against_the_article(spark, sf_dir):
    import html

    pages = {p.page_id: p.html for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op3_html_main_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner.replace("<br>", " "))]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = """<html><head><title>t</title></head><body class="home page"><header><a href=/>Home</a><h2>Site</h2></header>
<ul class="menu"><li><a href=/a>A</a></ul><div id="content"><h1>Title {n}</h1><p>First &amp; {n}&nbsp;para
graph <b>bold</b>.<p>Second<br>line<div class="share-box">Share!</div><form><input><p>Name</form>
<div class="ad-slot">Buy</div><p>{long}</p></div><div class="comments"><p>Reader {n} says</p></div><aside>x</aside><footer>f</footer></body></html>"""


def test_pages_without_article_tags(spark):
    rows = [(i, f"https://Host.example/{i}", PAGE.format(n=i, long="word " * (20 + i)), "x") for i in range(6)]
    rows += [(10, None, None, "x"), (11, "not a url", "", "x"), (12, "https://b.example/", "plain <b>text", "x"), (13, "https://b.example/", "<p>a<script>if (a</b) x='<p>'</script>b", "x")]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for i in range(6):
        assert got[i] == f"Title {i}\n\nFirst & {i} para graph bold.\n\nSecond line\n\n" + ("word " * (20 + i)).strip()
    assert got[10] == got[11] == "" and got[12] == "plain text" and got[13].split() == ["a", "b"] or got[13] == "ab"
    assert wrappers.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def wrapper_of(*pages):
    out = wrappers.expression(wrappers.parse(pages[0]))
    for p in pages[1:]:
        out = wrappers.merge(out, wrappers.expression(wrappers.parse(p)))
    return out


def test_wrappers_are_union_free():
    w = wrapper_of("<div><h1>a</h1><p>x</p><p>y</p></div>", "<div><h1>b</h1><ul><li>1</li><li>2</li></ul><p>z</p></div>")
    assert wrappers.shown(w) == "<><div><h1>#</h1>(<ul>(<li>#</li>)+</ul>)?(<p>#</p>)+</div></>"
    assert wrappers.shown(wrapper_of("<h1>Same</h1><p>a", "<h1>Same</h1><p>b")) == "<><h1>=</h1><p>#</p></>"
    assert wrappers.shown(wrappers.loaded(wrappers.dumped(w))) == wrappers.shown(w)


def test_slots_decide_where_the_article_is():
    """No tag or name tells the groups of these pages apart; what varies, what stays and what is linked does."""
    word = lambda i, n: " ".join(f"w{(i * 7919 + j * 31) % 1009}" for j in range(n))
    page = lambda i: (
        f"<body><div class=first>All texts are ours, and whoever reads them here agrees with all that we say. {'Again. ' * 9}</div>"
        f"<div class=second>{''.join(f'<div><a href=/{j}>{word(i + j, 4)}</a></div>' for j in range(6))}</div>"
        f"<div class=third><h2>{word(i, 4)}</h2><p>{word(i + 1, 30)}</p><div class=k>Sent from our office</div><p>{word(i + 2, 25)}</p></div></body>"
    )
    rule = wrappers.rule(wrapper_of(*map(page, range(8))))
    assert rule["path"] == ["body", "div.third"]
    for i in range(8):
        assert wrappers.extract(page(i), **rule) == "\n\n".join([word(i, 4), word(i + 1, 30), word(i + 2, 25)])


def test_few_equal_texts_are_no_template():
    pages = [f"<article><h1>T{i}</h1><p>the same</p><p>other {i}</p></article>" for i in range(4)]
    rule = wrappers.rule(wrapper_of(*pages))
    assert rule == {"path": ["article"], "template": []}
    assert wrappers.extract(pages[0], **rule) == "T0\n\nthe same\n\nother 0"


def test_nothing_else_is_dropped_from_an_article():
    page = "<article><p>Let <math>x</math> be.</p><object>kept</object><div class='related search alert form'>also</div><script>no</script><p>a<script>x</script>b</p></article>"
    assert wrappers.extract(page, ["article"]) == "Let x be.\n\nkept\n\nalso\n\nab"


def test_deep_wide_and_long_pages():
    deep = "<div>" * 100_000 + "text"
    assert wrappers.extract(deep, None) == "text"
    w = wrappers.loaded(wrappers.dumped(wrapper_of(deep, "<div>" * 50_000 + "other")))
    assert len(wrappers.shown(w)) > 1_000_000
    assert wrappers.extract("<div><p>x</p>" * 5000, None) == "\n\n".join(["x"] * 5000)
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    pages = ["".join(f"<div class={letters(60 * i + j)}>text {i} {j}</div>" for j in range(60)) for i in range(200)]
    w = wrapper_of(*pages)
    assert len(list(w.preorder())) <= 2 * wrappers.WIDTH + 2
    assert wrappers.extract(pages[3], **wrappers.rule(w)) == "\n\n".join(f"text 3 {j}" for j in range(60))
    assert len(list(wrapper_of(*[f"<{letters(i)}>x</{letters(i)}>" for i in range(500)]).preorder())) <= 2 * wrappers.WIDTH + 2
    many = "<p>word</p>" * 100_000
    assert wrappers.extract(many, None) == "\n\n".join(["word"] * 100_000)


def test_hosts_are_merged_by_levels(spark):
    rows = [(i, f"https://{'hot' if i % 3 else 'h' + str(i)}.example/{i}", f"<body><div class=x><p>{'word%d ' % i * 9}</p></div><div class=y>Same here</div></body>") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(24)
    found = wrappers.infer_wrappers(df, fan_in=2).collect()
    hot = next(r for r in found if r.host == "hot.example")
    assert len(found) == 101 and wrappers.loaded(hot.wrapper).pages == 200 and hot.path == ["body", "div.x"]
    assert {r.text for r in wrappers.main_text(df, broadcast_bytes=0).collect()} == {" ".join([f"word{i}"] * 9) for i in range(300)}


def test_short_credentials_are_candidates(spark):
    import random

    rng = random.Random(4)
    key = lambda: "".join(rng.choice("bcdfghjkmnpqrstvwxz" if i % 2 == 0 else "23456789") for i in range(12))
    rows = [(i, f"ordinary words with plain sentences and numbers 20240{i % 10} version-1.{i} then password = {key()} and more of them") for i in range(200)]
    grammar = secret_grammar.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    found = [any(k == "format" for *_, k, _ in grammar.spans(f"ordinary words {key()} more")[1]) for _ in range(50)]
    assert sum(found) >= 45
    assert grammar.spans("ordinary sentences, numbers 202405 and version-1.77 of something else")[1] == []
    assert grammar.spans(f"short {key()[:5]}")[1] == []


def test_long_lists_of_digests_take_linear_time(spark):
    import time

    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(150_000)]
    text = "\n".join(f"{d}  files/part-{i}.bin" for i, d in enumerate(digests))
    assert len(text) > 10_000_000
    grammar = secret_grammar.Grammar({"hex": secret_grammar.infer(digests[:50])}, {}, 0.3)
    began = time.perf_counter()
    base, spans = grammar.spans(text)
    assert len(base) == 150_000 and time.perf_counter() - began < 60
    assert secret_grammar.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_hex == 150_000
    # overlapping and nested base spans, walked side by side with the runs
    gaps = lambda runs, base: list(secret_grammar._gaps("a" * 200, runs, base))
    assert gaps([(0, 50), (60, 120)], [(5, 100, "k"), (10, 20, "k")]) == [(100, 120)]
    assert gaps([(0, 50), (60, 120)], [(10, 20, "k"), (15, 30, "k"), (70, 80, "k")]) == [(0, 10), (30, 50), (60, 70), (80, 120)]


def test_pages_parse_in_linear_time():
    import time

    began = time.perf_counter()
    wrappers.parse("<b><div>" + "<i>" * 200_000 + "</b>" * 200_000)
    wrappers.parse("<p>" * 200_000 + "<ul>" + "</p>" * 200_000)
    wrappers.parse("<p>a</p>" + "<a " * 200_000)
    assert time.perf_counter() - began < 60
    texts = lambda page: texts_of(wrappers.parse(page))[1]
    texts_of = lambda node: (node.tag, [c if isinstance(c, tuple) else texts_of(c) for c in node.children])
    # </b> does not reach beyond the div, </p> closes the p around the inline tags, <li> the one before it in its list
    assert texts("<b><div>x</b>y</div>z") == [("div", [("xy", 0)]), ("z", 0)]
    assert texts("<p>a<i>b<p>c") == [("p", [("ab", 0)]), ("p", [("c", 0)])]
    assert texts("<ul><li>a<ul><li>b</ul><li>c") == [("ul", [("li", [("a", 0), ("ul", [("li", [("b", 0)])])]), ("li", [("c", 0)])])]


def test_tags_stand_where_the_automaton_finds_them():
    labels = lambda text: set(licences.scan_text(text)["labels"].split(",")) - {""}
    for text in ("SPDX License Identifier: MIT", "spdx_license_identifier = MIT", "Licensed, under MIT", "Ünï licensed\n# under  the MIT"):
        assert "mit" in labels(text), text
        assert licences.scan_text(text)["score"] > 0.8, text
    assert labels("This is licensed under GNU GPL 3.0") == {"gpl-3.0"}
    assert labels("released under the terms of the Apache-2.0 OR (MIT AND BSD 3) licence") == {"apache-2.0", "mit", "bsd-3"}
    assert labels("licensed under") == set() and labels("x licensed under the") == set()
    many = "licensed, under MIT and " * 20_000
    assert licences.scan_text(many)["n_words"] == 80_000 and labels(many) == {"mit"}


def test_doubled_letters_white_space_shapes_and_joined_words(spark):
    around = "you are such a worthless go away now please sit down all letters will still be good".split()
    rng = random.Random(6)
    rows = [(i, " ".join(rng.sample(around, len(around)) + (["idiot", "stupid", "moron", "shit", "head"] if i % 3 == 0 else ["weather", "fine", "head"]))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) toxic"))
    telling = toxicity.Telling(model.weights)
    for token, word in (("iddiot", "idiot"), ("stuupid", "stupid"), ("i\nd\ni\no\nt", "idiot"), ("m\to\tr\to\tn", "moron"), ("st|_|pid", "stupid"), ("m()r()n", "moron"), ("sh1t-h34d", "shit"), ("you-1d10t", "idiot")):
        for t in (None, telling):
            assert word in toxicity.restored_words(token, model.chars, {}, t), token
    assert telling.may("stuppid") and not telling.may("letter") and not telling.may("all")
    clean = "all letters will still be good, please"
    assert toxicity.restored_words(clean, model.chars, {}, telling) == set(clean.replace(",", "").split())


def test_source_model_counts_all_documents_within_bounds(spark):
    rows = [(i, f"common word{'abcdefghij'[i % 10]}" + (" rare" if i < 3 else " often") + (" 漢字" if i == 0 else "")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = docs.limit(10).select("text")
    whole = toxicity._character_model(docs, sample)
    assert whole.words["often"] == 1997 and "rare" not in whole.words and whole.words["common"] == 2000
    derived = toxicity.CharModel(whole.tri)
    assert (derived.bi, derived.pairs, derived.starts, derived.uni) == whole.lower and derived.total == whole.total
    few = toxicity._character_model(docs, sample, rarest_gram=100, rarest_word=20)
    assert 0 < len(few.tri) <= 100 and len(few.words) <= 20 + 10 and few.uni == whole.uni and few.total == whole.total
    assert "^^漢" not in few.tri and few.logp("^", "^", "漢") < 0
