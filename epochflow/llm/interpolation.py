"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform distribution.

Counts are exchanged, not tokens: a task turns about `block_tokens` tokens into a block, which keeps its token stream
as local numbers and asks for the corpus counts of its distinct n-grams. Requests meet by key bucket, are summed over
all blocks, and the answers go back to each block, which then scores its documents. So a frequent word costs one
request a block, whatever its frequency, and no row is made for a token.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder_is, words_of, written

#: Folds of documents: counted, deleted (held-out counts for the weights; counted in the end), not to be learned from.
_KEPT, _DELETED, _APART = 0, 1, 2
#: The end token's place in a block's vocabulary, and the hash that stands before a text.
_END, _BEGIN = 0, np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
#: Histogram resolution of log10 maximum-likelihood estimates.
_STEP = 0.1


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each bigram, from the hashes of its words."""
    h = (first * _PAIR) ^ ((second << np.uint64(31)) | (second >> np.uint64(33)))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Block:
    """Documents of one fold with the tokens as numbers of a local vocabulary."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"\n": _END}
        self.ids: list = []
        self.lengths: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, words: list[bytes]) -> None:
        number = self.number
        self.tokens.append(np.array([number.setdefault(w, len(number)) for w in words] + [_END], dtype=np.uint32))
        self.ids.append(doc_id)
        self.lengths.append(len(words) + 1)
        self.size += len(words) + 1


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Where each document begins in the stream of its block."""
    return np.cumsum(lengths, dtype=np.int64) - lengths.astype(np.int64)


def _bigrams(hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of the stream, and the pair hash of each token with the one before it."""
    words = hashes[tokens]
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[_starts(lengths)] = _BEGIN
    return words, _pairs(before, words)


def _packed(numbers: np.ndarray, width: int) -> bytes:
    """The lower `width` bytes of each number, one plane a byte: of sorted or small numbers the upper planes vanish."""
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zlib.compress(np.ascontiguousarray(planes.T[::-1]).tobytes(), 1)


def _unpacked(body: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(width, -1)[::-1].T
    full = np.zeros((len(planes), 8), dtype=np.uint8)
    full[:, :width] = planes
    return full.view("<u8").ravel()


#: Bytes of an n-gram's key that are sent, by order; the bucket, taken from the upper bytes, tells further.
_WIDTH = {1: 8, 2: 5}
_BLOCKS = "block string, fold int, ids binary, lengths binary, vocabulary binary, tokens binary"


def _build(df: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of documents (id, text, fold), each of one fold."""

    def built(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[int, Block] = {}

        def done(fold: int) -> pd.DataFrame:
            b = open_.pop(fold)
            ids = np.array([(i is None or i != i, 0 if i is None or i != i else int(i)) for i in b.ids], dtype=[("null", "?"), ("id", "<i8")])
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in b.number], dtype=np.uint64)
            row = (uuid.uuid4().hex, fold, zlib.compress(ids.tobytes(), 1), _packed(np.array(b.lengths), 4), hashes.tobytes(), _packed(np.concatenate(b.tokens), 4))
            return pd.DataFrame([row], columns=[c.split()[0] for c in _BLOCKS.split(", ")])

        for part in batches:
            for doc_id, text, fold in zip(part["id"].astype(object), part["text"], part["fold"]):
                block = open_.setdefault(fold, Block())
                block.add(doc_id, words_of(text))
                if block.size >= block_tokens:
                    yield done(fold)
        for fold in list(open_):
            yield done(fold)

    return df.mapInPandas(built, _BLOCKS)


class Streams:
    """A block's document lengths, and the hashes of its words and bigrams in order."""

    def __init__(self, block: pd.Series):
        self.lengths, tokens = _unpacked(block["lengths"], 4).astype(np.int64), _unpacked(block["tokens"], 4)
        words, pairs = _bigrams(np.frombuffer(block["vocabulary"], np.uint64), tokens, self.lengths)
        self.of = {1: words, 2: pairs}


_REQUESTS = "block string, fold int, sort int, bucket int, n int, body binary, told binary"


def _ask(blocks: DataFrame, buckets: int) -> DataFrame:
    """A row for each block, order and bucket: the distinct keys (sorted, so buckets follow each other) and their counts.

    Blocks of documents not to be learned from tell no counts.
    """

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for _, block in part.iterrows():
                rows, streams = [], Streams(block)
                for order, stream in streams.of.items():
                    keys, counts = np.unique(stream, return_counts=True)
                    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                    for b in np.flatnonzero(np.diff(cuts)):
                        at = slice(cuts[b], cuts[b + 1])
                        told = b"" if block["fold"] == _APART else _packed(counts[at], 4)
                        rows.append((block["block"], int(block["fold"]), order, int(b), int(cuts[b + 1] - cuts[b]), _packed(keys[at], _WIDTH[order]), told))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _REQUESTS.split(", ")])

    return blocks.mapInPandas(asked, _REQUESTS)


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """Answers of one bucket and order: counts of each key in all learned blocks, for deleted ones in the kept, too.

    One more row (block null) has the bucket's part of the totals: distinct keys and tokens, learned and kept.
    """
    order, bucket = int(group["sort"].iloc[0]), int(group["bucket"].iloc[0])
    keys = np.concatenate([_unpacked(b, _WIDTH[order]) for b in group["body"]])
    ends = np.cumsum(group["n"].to_numpy(np.int64))
    distinct, inverse = np.unique(keys, return_inverse=True)
    del keys
    learned, kept = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    for fold, n, end, told in zip(group["fold"], group["n"], ends, group["told"]):
        if fold != _APART:
            counts, at = _unpacked(told, 4).astype(np.int64), inverse[end - n : end]
            learned[at] += counts  # a block's keys are distinct
            if fold == _KEPT:
                kept[at] += counts
    rows = [(None, -1, order, bucket, int((learned > 0).sum()), int(learned.sum()), int((kept > 0).sum()), int(kept.sum()), b"", b"")]
    for name, fold, n, end in zip(group["block"], group["fold"], group["n"], ends):
        at = inverse[end - n : end]
        rows.append((name, int(fold), order, bucket, int(n), 0, 0, 0, _packed(learned[at], 5), _packed(kept[at], 5) if fold == _DELETED else b""))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _ANSWERS.split(", ")])


_ANSWERS = "block string, fold int, sort int, bucket int, n bigint, total bigint, kept bigint, kept_total bigint, learned binary, apart binary"


class Answered:
    """A block with the corpus counts of its n-grams: of each token, its context, and both together."""

    def __init__(self, block: pd.Series, answers: pd.DataFrame, column: str):
        streams = Streams(block)
        self.ids = np.frombuffer(zlib.decompress(block["ids"]), dtype=[("null", "?"), ("id", "<i8")])
        self.lengths, self.first = streams.lengths, _starts(streams.lengths)
        counts = {}
        for order, stream in streams.of.items():
            inverse = np.unique(stream, return_inverse=True)[1]
            got = answers[answers["sort"] == order].sort_values("bucket")
            counts[order] = np.concatenate([_unpacked(b, 5) for b in got[column]]).astype(np.int64)[inverse]
        self.word, self.pair = counts[1], counts[2]
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.starts = np.zeros(len(self.word), dtype=bool)
        self.starts[self.first] = True

    def estimates(self, total: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context counts and maximum-likelihood estimates of orders 2 and 1; a text's start occurs once a text."""
        context = np.where(self.starts, texts, self.context)
        return context, np.where(self.pair > 0, self.pair / np.maximum(context, 1), 0.0), self.word / max(total, 1)


def context_bucket(context: np.ndarray) -> np.ndarray:
    """Buckets of the context's frequency: 0, then one for each power of two."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def _binned(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(np.log10(p) / _STEP), -9999).astype(np.int64)


def fit_weights(table: list[tuple[int, int, int, int]], uniform: float, rounds: int = 60) -> dict[int, tuple[float, float, float]]:
    """Weights of orders 2, 1, 0 for each context bucket, by expectation-maximisation on held-out counts.

    table: (bucket, binned log10 of both estimates, tokens). Half a token for each weight keeps all of them above zero.
    """
    out = {}
    for b in sorted({r[0] for r in table}):
        rows = np.array([r[1:] for r in table if r[0] == b], dtype=np.float64)
        p = np.stack([np.where(rows[:, i] > -9999, 10 ** (rows[:, i] * _STEP), 0.0) for i in (0, 1)] + [np.full(len(rows), uniform)])
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = w[:, None] * p
            share /= share.sum(axis=0)
            w = (share * rows[:, 2]).sum(axis=1) + 0.5
            w /= w.sum()
        out[b] = tuple(w)
    return out


def scores(df: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = 7, held_out: int = 2, block_tokens: int = 1_000_000, bucket_chars: int = 4_000_000, deleted_share: int = 10) -> DataFrame:
    """One row per document: id_col (bigint), held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Learns from documents whose crc32(id as text) mod modulus is not held_out (null ids are learned from). Counts for
    the mixture weights leave out one in `deleted_share` of those documents, on whose counts the weights are fitted;
    the model then counts all of them. Null and empty texts are the end token alone; repeated rows count and stay; an
    empty table gives an empty result; other columns are neither read nor returned. Where nothing is learned all
    estimates are uniform.
    """
    apart = remainder_is(id_col, modulus, held_out)
    deleted = F.pmod(F.xxhash64(F.lit("deleted"), F.col(id_col)), F.lit(deleted_share)) == 0
    fold = F.when(apart, _APART).when(deleted, _DELETED).otherwise(_KEPT)
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), fold.alias("fold"))
    sums = docs.agg(F.sum(F.length("text")), F.count_if(F.col("fold") != _APART), F.count_if(F.col("fold") == _KEPT)).first()
    buckets = max(8, (sums[0] or 0) // bucket_chars)
    blocks = written(_build(docs, block_tokens), "blocks")
    answers = written(_ask(blocks, buckets).groupBy("sort", "bucket").applyInPandas(_summed, _ANSWERS), "answers")
    totals = answers.where("block is null and sort = 1").agg(*[F.sum(c) for c in ("n", "total", "kept", "kept_total")]).first()
    vocabulary, total, kept_vocabulary, kept_total = (int(x or 0) for x in totals)

    def held(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, b in left.iterrows():
            got = Answered(b, right, "apart")
            context, p2, p1 = got.estimates(kept_total, sums[2])
            parts.append(np.stack([context_bucket(context), _binned(p2), _binned(p1)]))
        cells, n = np.unique(np.concatenate(parts, axis=1), axis=1, return_counts=True)
        return pd.DataFrame({"b": cells[0], "p2": cells[1], "p1": cells[2], "n": n})

    pick = lambda d, c: d.where(c).groupBy("block")
    table = pick(blocks, f"fold = {_DELETED}").cogroup(pick(answers, f"fold = {_DELETED}")).applyInPandas(held, "b bigint, p2 bigint, p1 bigint, n bigint")
    # A few hundred values each: buckets are powers of two, estimates are binned.
    cells = [tuple(r) for r in table.groupBy("b", "p2", "p1").agg(F.sum("n")).collect()]
    weights = fit_weights(cells, 1 / (kept_vocabulary + 1))
    everywhere = np.mean(list(weights.values()), axis=0) if weights else np.array([0.0, 0.0, 1.0]) if not total else np.full(3, 1 / 3)
    top = max(weights, default=0)
    mix = np.array([weights.get(b, weights[top] if weights and b > top else everywhere) for b in range(64)])

    def scored(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, b in left.iterrows():
            got = Answered(b, right, "learned")
            context, p2, p1 = got.estimates(total, sums[1])
            w = mix[context_bucket(context)]
            model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (vocabulary + 1))
            base = np.log10((got.word + 1) / (total + vocabulary + 1))
            add = lambda x: np.add.reduceat(x, got.first)
            ids = pd.Series(got.ids["id"]).astype("Int64").mask(pd.Series(got.ids["null"]))
            parts.append(pd.DataFrame({"id": ids, "held_out": int(b["fold"]) == _APART, "n_tokens": got.lengths.astype(np.int64), "n_known": add((got.word > 0).astype(np.int64)), "base_score": add(base), "score": add(model)}))
        return pd.concat(parts)

    out = blocks.groupBy("block").cogroup(answers.where("block is not null").groupBy("block"))
    out = out.applyInPandas(scored, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
