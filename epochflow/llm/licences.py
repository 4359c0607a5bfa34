"""Licence scans: Aho-Corasick over words finds notices and tags, a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose places are counted, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notice phrases, with their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "dedicated to the public domain": "public-domain",
    "creative commons": "cc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by": "cc-by",
    "cc0": "cc0",
    "all rights reserved": "all-rights-reserved",
}

# Words that announce an expression, and what it may consist of.
TAGS = ("spdx license identifier", "licensed under", "released under", "available under", "distributed under")
FAMILIES = ("mit", "apache", "gpl", "lgpl", "agpl", "bsd", "mpl", "epl", "isc", "cc0", "cc-by", "unlicense", "zlib", "bsl", "artistic", "wtfpl", "0bsd", "afl", "ecl", "cddl", "python", "postgresql", "ofl")
EXCEPTIONS = ("classpath-exception", "llvm-exception", "gcc-exception", "autoconf-exception", "bison-exception", "linux-syscall-note", "openssl-exception", "font-exception")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}

# Bytes: A-Z lower-cased, other ASCII but digits and letters to a space, the rest kept.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# After a tag's last word: marks and white space, and words that lead to the licence's name.
_LEAD = re.compile(r"[^\w(.]*(?:(?:the|terms|of|a|an|version|gnu)\b[^\w(.]*)*", re.I)
# Between tokens: white space over at most one line's end (any number within brackets), with the next line's comment mark.
_LINE, _ID = r"(?:\n[^\S\n]*(?:(?://+|#+|\*+|;+|--+)[^\S\n]*)?)", r"(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)"
_TOKEN, _INNER = re.compile(rf"[^\S\n]*{_LINE}?{_ID}"), re.compile(rf"[^\S\n]*{_LINE}*{_ID}")
_NUMBER = re.compile(r"(?:version |v\.? ?)?(\d{1,2}(?:\.\d{1,3})*)(?:\+|-or-later|-only)?", re.I)
_VERSION = re.compile(r" (?:(?:version|v) ?|v)?(\d{1,2})(?: (\d{1,2}))?(?= |$)")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICES, *TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def _known(token: str, allowed: tuple[str, ...]) -> bool:
    return any(token == f or token.startswith(f + "-") for f in allowed)


def evaluate(text: str, at: int = 0) -> tuple[set[str], float] | None:
    """Labels and confidence of the licence expression that the text begins with at a place; None if there is none.

    Shunting-yard with `with` before `and` before `or`. A licence id has confidence 1 if its family is known and 0.5 if
    not; `and` takes the lower, `or` the higher, `with` multiplies by 0.8 if the exception is unknown. The longest
    beginning that is a whole expression counts; brackets left open end it.
    """
    ids: list[str] = []
    values: list[float] = []
    stack: list[str] = []
    operand, best = True, None

    def combine(ops: list[str], of: list[float]) -> None:
        op, right, left = ops.pop(), of.pop(), of.pop()
        of.append({"and": min, "or": max, "with": lambda x, y: x * (1.0 if y >= 1 else 0.8)}[op](left, right))

    def whole() -> tuple[int, float]:
        """How many ids the expression has so far, and its confidence."""
        ops, of = list(stack), list(values)
        while ops:
            combine(ops, of)
        return len(ids), of[-1]

    while m := (_INNER if "(" in stack else _TOKEN).match(text, at):
        raw = m[1].rstrip(".-")
        token = raw.lower()
        if operand:
            if token == "(":
                stack.append("(")
            elif token in _PRECEDENCE or token == ")" or token == "spdx-license-identifier":
                break
            else:
                exception = bool(stack) and stack[-1] == "with"
                known = _known(token, EXCEPTIONS if exception else FAMILIES)
                if not known and not re.search(r"[-\d]", token):
                    break
                ids.append(token)
                values.append(1.0 if known else 0.5)
                operand = False
        elif (v := _NUMBER.fullmatch(raw)) and ids and not re.search(r"\d$", ids[-1]):
            ids[-1] += f"-{v[1]}"  # "GPL 3.0" is one id
        elif token in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[token]:
                combine(stack, values)
            stack.append(token)
            operand = True
        elif token == ")":
            while stack and stack[-1] != "(":
                combine(stack, values)
            if not stack:
                break
            stack.pop()
        else:
            break
        at = m.end()
        if not operand and "(" not in stack:
            best = whole()
        if raw != m[1] and not operand:
            break
    return best and (set(ids[: best[0]]), best[1])


def scan_text(text: str | None) -> dict:
    """Counts, places, labels and score of one text (null: empty)."""
    raw = text or ""
    words = raw.encode("utf-8", "replace").translate(_WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}
    hits = [(end - len(phrase) - 1, end, phrase) for end, phrase in _automaton().iter(line)]
    if not hits:
        return out
    base, more, starts, miss = set(), set(), [], 1.0
    widest: dict[int, int] = {}
    for start, end, _ in hits:
        widest[start] = max(widest.get(start, 0), end)
    for start, end, phrase in hits:
        if phrase in BASE_PHRASES:
            base.add(BASE_PHRASES[phrase])
            starts.append(start)
            miss *= 0.3
        if (label := BASE_PHRASES.get(phrase) or NOTICES.get(phrase)) and end == widest[start]:
            more.add(label)
            if v := _VERSION.match(line, end):
                more.add(f"{label}-{v[1]}" + f".{v[2]}" * bool(v[2]))
            miss *= 0.5
    if tags := [end for _, end, phrase in hits if phrase in TAGS]:
        ends = [m.end() for m in _WORD.finditer(raw)]  # of the words that the automaton read, in the text as it is
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
        for last in np.searchsorted(spaces, tags) - 1:
            if found := evaluate(raw, _LEAD.match(raw, ends[last]).end()):
                more |= found[0]
                miss *= 1 - 0.9 * found[1]
            else:
                miss *= 0.9
    if starts:
        at = [line.count(" ", 0, s) for s in (min(starts), max(starts))]
        out |= {"n_base": len(starts), "first_word": at[0], "last_word": at[1]}
    return out | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more)), "score": 1 - miss}


_FIELDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, empty labels, null places and score 0; repeated rows stay; an empty table gives
    an empty result. labels holds base_labels, the further notices (with versions as name-2.0) and the ids of licence
    expressions after a tag; score is the confidence that the text states a licence. Other columns are not returned.
    """

    @F.pandas_udf(_FIELDS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([scan_text(t) for t in texts], columns=[f.split()[0] for f in _FIELDS.split(", ")])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return df.select(F.col(id_col), found(F.col(text)).alias("f")).select(id_col, "f.*")
