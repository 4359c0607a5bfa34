"""Byte-level BPE encoding and decoding; long unsplit text is encoded in halves that are joined exactly."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What that pattern takes as white space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: What a tokenizers file must say (where it says it) for this encoder to give its ids.
_EXPECTED = {
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "decoder": {"type": "ByteLevel"},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}
#: Threads that encode the pieces of one long text.
_THREADS = 4
#: A window's end is this many code points or more from the cut, beyond any contraction or special token it splits.
_CLEAR = 48


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 is itself, other bytes count up from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _checked(data: dict) -> dict[bytes, int]:
    """The ranks of a tokenizers file; raises where the file asks for what this encoder doesn't do."""
    for part, said in _EXPECTED.items():
        for key, value in said.items():
            if (data[part] or {}).get(key, value) not in (value, value or ""):
                raise ValueError(f"{part}.{key} is {data[part][key]!r}, not {value!r}")
    if data["normalizer"] is not None:
        raise ValueError("texts would be normalised")
    special = [t["content"] for t in data["added_tokens"]]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in data["added_tokens"]) or any(re.search(f"[{_SPACE}]", s) for s in special):
        raise ValueError("added tokens take white space or whole words only")
    vocab, alphabet = data["model"]["vocab"], _byte_alphabet()
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in data["model"]["merges"]]
    order = [vocab[t] for t in merged]
    single = [t for t in vocab if len(t) == 1]
    if order != sorted(order) or len(single) + len(merged) != len(vocab.keys() - set(special)) or max(vocab[t] for t in single) > min(order, default=1 << 31):
        raise ValueError("ids don't follow the merges")
    return {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}


class Bpe:
    """A tokenizers JSON file (byte-level BPE whose ids follow its merges), for encoding and decoding whole texts."""

    def __init__(self, spec: bytes, piece: int = 4096):
        data = json.loads(spec)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_checked(data), special_tokens=self.special)
        self.longest = max(map(len, self.special), default=0)
        self.piece = piece
        self.spaces, self.unsplit = re.compile(f"[{_SPACE}]{{{piece},}}"), re.compile(f"[^{_SPACE}]{{{piece}}}")

    def encode(self, text: str) -> list[int]:
        """The ids of the whole text. Long runs of white space and long texts without any are encoded in pieces."""
        if len(text) <= self.piece:
            return self._plain(text)
        out, at = [], 0
        for m in self.spaces.finditer(text):
            # The run's last character goes with what follows; at the end of the text, or before a special token, it stays.
            end = m.end() if m.end() == len(text) or any(text.startswith(s, m.end()) for s in self.special) else m.end() - 1
            out += self._words(text[at : m.start()])
            out += self._pieces(text[m.start() : end], True)
            at = end
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[int]:
        return self._pieces(text, False) if self.unsplit.search(text) else self._plain(text)

    def _pieces(self, text: str, spaces: bool) -> list[int]:
        cuts = list(range(0, len(text), self.piece)) + [len(text)]
        halves = self.coder.encode_batch([text[a:b] for a, b in zip(cuts, cuts[1:])], num_threads=_THREADS, allowed_special="all")
        return self._tree(text, cuts, [np.array(h, dtype=np.int64) for h in halves], spaces).tolist()

    def _plain(self, text: str) -> list[int]:
        return self.coder.encode(text, allowed_special="all")

    def decode(self, ids) -> str:
        return self.coder.decode(ids)

    def _tree(self, text: str, cuts: list[int], parts: list[np.ndarray], spaces: bool) -> np.ndarray:
        """Joins neighbours, then neighbours of those, until one is left."""
        while len(parts) > 1:
            joined = [self.join(text[cuts[i] : cuts[i + 2]], cuts[i + 1] - cuts[i], parts[i], parts[i + 1], spaces) for i in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(parts) // 2 * 2 :]
            cuts = cuts[:-1:2] + cuts[-1:]
        return parts[0]

    def join(self, text: str, cut: int, left: np.ndarray, right: np.ndarray, spaces: bool = False) -> np.ndarray:
        """The ids of text, from those of text[:cut] and text[cut:]. A text of white space alone may be cut anywhere.

        Encodes a window around the cut anew, and twice as wide until its first token is the left side's at that place
        and its last the right side's. A byte-pair encoding is right as a whole if each two neighbours are right as a
        pair, so then nothing outside the window can change. Windows start and end where the split pattern sees the
        same on a part as on the whole (see _clean); a side that the window covers needs no agreement.
        """
        starts, ends = self._starts(text[:cut], left), self._starts(text[cut:], right)
        width = 2 * _CLEAR
        while True:
            i = self._edge(text, starts, len(left), cut - width, -1, spaces)
            j = self._edge(text, ends + cut, len(right), cut + width, 1, spaces)
            a = 0 if i is None else int(starts[i])
            b = len(text) if j is None else cut + int(ends[j])
            window = np.array(self.coder._encode_single_piece(text[a:b]) if spaces else self._plain(text[a:b]), dtype=np.int64)
            if (i is None or len(window) and window[0] == left[i]) and (j is None or len(window) and window[-1] == right[j - 1]):
                return np.concatenate([left[: i or 0], window, right[len(right) if j is None else j :]])
            width *= 2

    def _starts(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The code point at which each token starts, -1 where that is within one."""
        sizes = np.array([len(t) for t in self.coder.decode_tokens_bytes(ids.tolist())], dtype=np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        lead = (raw & 0xC0) != 0x80
        point = np.cumsum(lead) - 1
        return np.where(lead[at], point[at], -1) if len(at) else at

    def _edge(self, text: str, starts: np.ndarray, n: int, want: int, step: int, spaces: bool) -> int | None:
        """The token nearest to `want`, going outwards, at whose start the text may be cut; None at the text's end."""
        order = range(n - 1, 0, -1) if step < 0 else range(1, n)
        for k in order:
            at = int(starts[k])
            if at >= 0 and (at <= want if step < 0 else at >= want) and (spaces or self._clean(text, at)):
                return k
        return None

    def _clean(self, text: str, at: int) -> bool:
        """Whether the pattern splits text[:at] and text[at:] as it splits the whole, but for a word that ends in at.

        So it is before white space that follows something else, and between two letters, two digits or two other
        marks, if no apostrophe or special token is near.
        """
        before, after = text[at - 1 : at], text[at : at + 1]
        if not before or not after:
            return False
        near = text[max(0, at - self.longest) : at + self.longest]
        close = text[max(0, at - 4) : at + 4]
        if any(s[:1] in near for s in self.special) or "'" in close and any(_kind(c) == "L" for c in close):
            return False
        if before.isspace():
            return False
        return after.isspace() or _kind(before) == _kind(after)


def _kind(c: str) -> str:
    major = unicodedata.category(c)[0]
    return major if major in "LN" else "other"


@lru_cache(maxsize=4)
def _loaded(spec: bytes, piece: int) -> Bpe:
    return Bpe(spec, piece)


def load(path: str, piece: int = 4096) -> Bpe:
    with open(path, "rb") as f:
        return _loaded(f.read(), piece)


def encode_column(df: DataFrame, path: str, text: str = "text", out: str = "ids", piece: int = 4096, rows: int = 256) -> DataFrame:
    """Adds the ids of each whole text (array<int>; null and empty texts: empty); a column of that name is replaced.

    The file is sent to the tasks (a few MB). A task holds the ids of `rows` texts at a time.
    """
    with open(path, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    if out != text:
        df = df.drop(out)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(spec.value, piece)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = [coder.encode(t or "") for t in part.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out])

    return df.mapInArrow(encoded, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode_column(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", piece: int = 4096) -> DataFrame:
    """Adds the text of each array of ids (null: empty), special tokens included; broken UTF-8 becomes U+FFFD."""
    with open(path, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _loaded(spec.value, piece)
        for rows in batches:
            yield pd.Series([coder.decode([] if r is None else list(map(int, r))) for r in rows], dtype=object)

    return df.withColumn(out, decoded(F.col(ids)))


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", piece: int = 4096) -> DataFrame:
    """id_col, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (UTF-8).

    One row per input row; null and empty texts have no tokens and the digests of nothing; other columns are not
    returned. Encodes and decodes in one pass, so that ids never leave the task.
    """
    with open(path, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _loaded(spec.value, piece)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for texts in batches:
            rows = []
            for t in texts:
                ids = coder.encode(t or "")
                rows.append((len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(coder.decode(ids).encode("utf-8"))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col), digest(F.col(text)).alias("d")).select(id_col, "d.*")
