"""Toxicity: disguised words are restored by a noisy channel (Viterbi over character lattices), then texts are scored.

The channel writes a letter as itself, as a look-alike, with marks in between, or several times; the source is a
character trigram model of the corpus' words, which may end within a token. Texts spaced out letter by letter are split
into known words. Words (and
beginnings of words) that are significantly more frequent in documents labelled toxic carry the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder_is, words_of, written

# Look-alikes and the letters they may stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SHAPES = {"|_|": "u", "()": "o", "\\/": "v", "/\\": "a", "|)": "d", "|<": "k"}
_MARKS = set(".-_*~'\"’`^·,:;/\\#%&=?<>[]{}) ")
_EDGE = "".join(_MARKS - {" "}) + "!|+($@"
_DOUBLE, _TRIPLE = re.compile(r"([^\W\d_])\1"), re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\s.\-_*]+[^\W_]){2,}(?![^\W_])")
_JOINT = re.compile(r"[-_.,:;/&?=~*]+")
_WORD, _REPEATED = re.compile(r"[^\W\d_]+"), re.compile(r"(.)\1+", re.S)
#: Log costs of the channel: a look-alike, a mark left out, another sign left out, a repeated letter left out.
_LOOK, _MARK, _SIGN, _AGAIN = -1.0, -0.4, -6.0, -1.2
#: Restored tokens up to this length are kept for their next occurrence; longer ones are restored each time.
_KEPT = 40


@dataclass
class CharModel:
    """Interpolated character trigrams; ^ begins a word and $ ends it. Beside them words and their counts.

    lower: counts of contexts of two letters, of pairs, of letters before another and of letters, where tri lacks rare
    trigrams; else they are summed from tri.
    """

    tri: dict[str, int]
    words: dict[str, int] = field(default_factory=dict)
    lower: tuple[dict, dict, dict, dict] | None = None
    sizes: list[int] = field(init=False)
    bi: dict[str, int] = field(init=False)
    pairs: dict[str, int] = field(init=False)
    uni: dict[str, int] = field(init=False)
    total: int = field(init=False)
    seen: dict[str, float] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.sizes = sorted({len(w) for w in self.words})
        self.bi, self.pairs, self.starts, self.uni = self.lower or tuple(defaultdict(int) for _ in range(4))
        for g, n in self.tri.items() if not self.lower else ():
            self.bi[g[:2]] += n
            self.pairs[g[1:]] += n
            self.starts[g[1]] += n
            self.uni[g[2]] += n
        self.total = sum(self.uni.values()) + 1

    def logp(self, a: str, b: str, c: str) -> float:
        key = a + b + c
        if key not in self.seen:
            p3 = self.tri.get(key, 0) / max(1, self.bi.get(a + b, 0))
            p2 = self.pairs.get(b + c, 0) / max(1, self.starts.get(b, 0))
            self.seen[key] = math.log(0.6 * p3 + 0.3 * p2 + 0.1 * (self.uni.get(c, 0) + 0.1) / self.total)
        return self.seen[key]


def restore(token: str, model: CharModel, apart: bool = False) -> str:
    """The likeliest letters behind a token (Viterbi over all states; a state is the last two letters).

    apart: words may also end at marks, and a space stands between them. Paths share their letters as linked pairs,
    so time and memory grow with the length only.
    """
    best: list[dict[tuple[str, str], tuple[float, tuple | None]]] = [{("^", "^"): (0.0, None)}]
    best += [{} for _ in token]
    for at, c in enumerate(token):
        options = [(c, 0.0, 1)] if c.isalpha() else []
        options += [(x, _LOOK, 1) for x in LOOKALIKES.get(c, "")]
        options += [(x, _LOOK, len(shape)) for shape, x in SHAPES.items() if shape[0] == c and token.startswith(shape, at)]
        cost = _MARK if c in _MARKS else _SIGN
        for (a, b), (p, out) in best[at].items():
            steps = [((b, x), p + w + model.logp(a, b, x), x, size) for x, w, size in options]
            if not c.isalpha():
                steps.append(((a, b), p + cost, "", 1))
                if apart and c in _MARKS and b != "^":
                    steps.append((("^", "^"), p + cost + model.logp(a, b, "$"), " ", 1))
            elif c == b and at and token[at - 1] == c:
                steps.append(((a, b), p + _AGAIN, "", 1))
            for state, q, x, size in steps:
                new = best[at + size]
                if state not in new or q > new[state][0]:
                    new[state] = (q, (out, x) if x else out)
        best[at] = {}
    ends = [(p + model.logp(a, b, "$"), out) for (a, b), (p, out) in best[-1].items()]
    top = max(p for p, _ in ends)
    return max(_letters(out) for p, out in ends if p == top)


def _letters(linked: tuple | None) -> str:
    out = []
    while linked:
        linked, x = linked
        out.append(x)
    return "".join(reversed(out))


def split(letters: str, model: CharModel) -> list[str]:
    """The likeliest words that the letters of a spaced-out run are (Viterbi; a state is the place where a word ends).

    Known words cost their share; a letter outside them costs more than any word, and such neighbours stay together.
    """
    total = math.log(sum(model.words.values()) + 1)
    best = [(0.0, 0, True)]
    for end in range(1, len(letters) + 1):
        steps = [(best[end - 1][0] + math.log(0.1) - total, end - 1, False)]
        for size in model.sizes:
            if size > end:
                break
            if n := model.words.get(letters[end - size : end]):
                steps.append((best[end - size][0] + math.log(n) - total, end - size, True))
        best.append(max(steps))
    out, at, after = [], len(letters), True
    while at:
        _, start, known = best[at]
        if known or after:
            out.append(letters[start:at])
        else:
            out[-1] = letters[start:at] + out[-1]
        at, after = start, known
    return out[::-1]


def _once(word: str) -> str:
    """The word with each repeated letter once."""
    return _REPEATED.sub(r"\1", word)


def restored_words(text: str | None, model: CharModel | None, cache: dict, telling: Telling | None = None) -> set[str]:
    """The distinct lower-case words of the text; disguised ones come restored, beside their letters as they stand.

    With `telling`, words with doubled letters are only restored where that may give a word that tells.
    """
    low = (text or "").lower()
    words = set()
    tokens = set(low.split())
    double, triple = bool(_DOUBLE.search(low)), bool(_TRIPLE.search(low))
    for token in tokens:
        core = token.strip(_EDGE)
        if not core:
            continue
        again = double and _DOUBLE.search(core) and (triple and _TRIPLE.search(core) or not telling or telling.may(core))
        if core.isalpha() and not again:
            words.add(core)
            if core == token:
                continue
            at = token.index(core)
            lead, tail = token[:at], token[at + len(core) :]
            disguised = len(lead) == 1 and lead in LOOKALIKES or len(tail) == 1 and tail in LOOKALIKES and tail != "!"
        else:
            words.update(_WORD.findall(token))
            disguised = not core.isdigit()
        if model and disguised:
            if token in cache:
                words |= cache[token]
                continue
            found = {w for part in {core, token} for w in (restore(part, model), *restore(part, model, True).split())}
            found |= {restore(part, model) for part in _JOINT.split(core) if len(part) > 2 and not part.isalpha()}
            if len(token) <= _KEPT:
                if len(cache) > 20_000:
                    cache.clear()
                cache[token] = found
            words |= found
    if model:
        for m in _SPACED.finditer(low):
            words.add(glued := restore(" ".join(m[0].split()), model))
            words.update(split(glued, model))
    words.discard("")
    return words


def features(words: set[str], prefix: int = 5) -> set[str]:
    """Words, and beginnings (marked by *) of words longer than that."""
    return words | {w[:prefix] + "*" for w in words if len(w) > prefix}


class Telling:
    """Which words may be spellings of words and beginnings that tell, with letters doubled."""

    def __init__(self, features_: Iterable[str]):
        self.whole = {_once(f) for f in features_ if not f.endswith("*")}
        self.begin = {_once(f[:-1]) for f in features_ if f.endswith("*")}
        self.sizes = sorted({len(f) for f in self.begin})

    def may(self, word: str) -> bool:
        once = _once(word)
        return once in self.whole or any(once[:n] in self.begin for n in self.sizes)


@dataclass(frozen=True)
class Model:
    """Character model, log-odds of the features that tell, and of the prior."""

    chars: CharModel
    weights: dict[str, float]
    prior: float

    def score(self, found: set[str]) -> float:
        z = self.prior + sum(self.weights[f] for f in found & self.weights.keys())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _low(hits: int, n: int, z: float) -> float:
    """Lower end of Wilson's interval of a share."""
    p = hits / n
    return (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def _one_of_copies(text: str | None, shingle: int = 5) -> int:
    """The least hash of a text's word shingles: equal for most near copies, so that those count once."""
    words = words_of(text)
    grams = zip(*(words[i:] for i in range(min(shingle, max(1, len(words))))))
    return min((xxhash.xxh64_intdigest(b" ".join(g)) >> 1 for g in grams), default=0)


def _character_model(texts: DataFrame, sample: DataFrame, rarest_gram: int = 1_000_000, rarest_word: int = 200_000) -> CharModel:
    """The source model, counted over all texts: words by how many texts have them, and the trigrams of those words.

    What is rarer than one of `rarest_gram` trigrams is left to the lower orders, so that at most so many trigrams,
    contexts and pairs come to the driver whatever the scripts are; letters are at most as many as Unicode has. Words
    come if they are one of `rarest_word` pairs of a word and a text (4 at least), or in 4 texts of the bounded sample.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def sent() -> pd.DataFrame:
            out = pd.DataFrame(list(held.items()), columns=["w", "n"])
            held.clear()
            return out

        for part in batches:
            for t in part["text"]:
                held.update(set(_WORD.findall((t or "").lower())))
                if len(held) > 200_000:
                    yield sent()
        yield sent()

    def trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            grams: Counter = Counter()
            for w, k in zip(part["w"], part["n"]):
                w = f"^^{w}$"
                for i in range(len(w) - 2):
                    grams[w[i : i + 3]] += k
            yield pd.DataFrame(list(grams.items()), columns=["g", "n"])

    n = F.sum("n").alias("n")
    words = written(texts.mapInPandas(found, "w string, n bigint").groupBy("w").agg(n), "words")
    grams = written(words.mapInPandas(trigrams, "g string, n bigint").groupBy("g").agg(n), "trigrams")
    all_words, all_grams = (d.agg(F.sum("n")).first()[0] or 0 for d in (words, grams))

    def counts(key, least: float) -> dict[str, int]:
        return defaultdict(int, {r["k"]: r["n"] for r in grams.groupBy(key.alias("k")).agg(n).where(F.col("n") >= least).collect()})

    g, least = F.col("g"), all_grams / rarest_gram
    lower = tuple(counts(F.substring(g, at, size), bound) for at, size, bound in ((1, 2, least), (2, 2, least), (2, 1, 0), (3, 1, 0)))
    in_sample = sample.mapInPandas(found, "w string, n bigint").groupBy("w").agg(n).where("n >= 4").select("w").withColumn("sampled", F.lit(True))
    known = words.join(in_sample, "w", "left").where(F.col("sampled") | (F.col("n") >= max(4.0, all_words / rarest_word)))
    return CharModel(dict(counts(g, least)), {r["w"]: r["n"] for r in known.collect()}, lower)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 5, held_out: int = 0, most_rows: int = 20_000, z: float = 2.58) -> Model:
    """Fits on labelled documents whose crc32(id as text) mod modulus is not held_out.

    Bounded: of those labels the `most_rows` with the lowest id hash are used (an id with several labels takes the
    largest; null ids and labels are left out). Near copies among them count once. The channel's words and trigrams are
    counted over all documents. Without labels of both classes the model has no weights and scores everything with the prior.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~remainder_is(id_col, modulus, held_out))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(F.broadcast(known), "_id").select("text", "_y")

    @F.pandas_udf("bigint")
    def copy_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([_one_of_copies(t) for t in part], dtype="int64")

    sample = written(texts.withColumn("k", copy_key("text")).groupBy("k", "_y").agg(F.min("text").alias("text")), "labelled")
    classes = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}

    chars = _character_model(docs.select(F.col(text).alias("text")), sample)
    sent = docs.sparkSession.sparkContext.broadcast(chars)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for part in batches:
            n: Counter = Counter()
            for t, y in zip(part["text"], part["_y"]):
                n.update((f, y) for f in features(restored_words(t, sent.value, cache)))
            yield pd.DataFrame([(f, y == 1, y == 0, k) for (f, y), k in n.items()], columns=["f", "t", "c", "n"])

    toxic, clean = classes.get(1, 0), classes.get(0, 0)
    prior = math.log((toxic + 0.5) / (clean + 0.5)) if toxic or clean else -2.0
    if not toxic or not clean:
        return Model(chars, {}, min(prior, -0.1) if toxic == 0 else prior)
    rows = sample.mapInPandas(counted, "f string, t boolean, c boolean, n bigint").groupBy("f")
    rows = rows.agg(F.sum(F.when(F.col("t"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("c"), F.col("n")).otherwise(0)).alias("c"))
    weights = {}
    for r in rows.where("t >= 4 and t > c").collect():
        if (low := _low(r["t"], r["t"] + r["c"], z)) > 0.5:
            weights[r["f"]] = math.log(low / (1 - low)) - min(prior, 0.0)
    return Model(chars, weights, min(prior, -0.5))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with toxicity (0 to 1). Null and empty texts get the prior; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by learn()'s most_rows and by the character model's bounds

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        telling = Telling(sent.value.weights)
        for texts in batches:
            yield pd.Series([sent.value.score(features(restored_words(t, sent.value.chars, cache, telling))) for t in texts], dtype="float64")

    return docs.withColumn("toxicity", scored(F.col(text)))


def scan(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = 5, held_out: int = 0, **learning) -> DataFrame:
    """One row per document: id_col, held_out, score, predicted (1 from 0.5 on). Null ids are never held out.

    Repeated rows stay; empty tables give empty results; other columns are neither read nor returned.
    """
    model = learn(docs, labels, id_col, text, modulus=modulus, held_out=held_out, **learning)
    out = score(docs.select(id_col, text), model, id_col, text)
    return out.select(id_col, remainder_is(id_col, modulus, held_out).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
