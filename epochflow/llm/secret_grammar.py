"""Secret scans: fixed patterns, and automata learned from the credentials that those patterns label.

Learning (ALERGIA): strings of a kind make a prefix tree of character classes; states whose outgoing frequencies do
not differ by Hoeffding's bound are merged. A token of six characters or more that a learned automaton accepts, and that it
finds so much likelier than ordinary tokens of the corpus that a secret is likelier than not, is a secret too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("assign", "access", "hex", "format")
_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Candidates are what the base patterns take for a credential: six token characters or more.
_LEAST = 6
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{_LEAST},}}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Tokens up to this length are scored together, a character at a time; longer ones one by one.
_LOCKSTEP = 200
_IS_LETTER, _IS_DIGIT = (np.array([of(chr(c)) for c in range(128)]) for of in (str.isalpha, str.isdigit))
#: Ordinary tokens have a distribution of their own in each form: numbers are unlike words, and both unlike mixed tokens.
_FORMS = ("number", "word", "mixed")
_MARKED = re.compile("[=/.]")
_CUTS = [re.compile(f"[{marks}]") for marks in ("=", "/", ".", "=/", "=.", "/.", "=/.")]
#: Characters of each class; what is in none stands for itself.
_CLASSES = {"d": "0123456789", "x": "abcdef", "l": "ghijklmnopqrstuvwxyz", "X": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS_OF = {c: k for k, cs in _CLASSES.items() for c in cs}
_SIZE = {k: len(cs) for k, cs in _CLASSES.items()}


def base_spans(text: str) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int]]]:
    """(start, end, kind, credential) of the fixed patterns, by start and kind; and runs of _LEAST or more token characters."""
    out, runs = [], [m.span() for m in _RUN.finditer(text)]
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(*m.span(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access", m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    for a, b in runs:  # a run of 24 hex digits lies in one of these
        if b - a >= 24:
            out += [(*m.span(), "hex", m[0]) for m in _HEX.finditer(text, a, b) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]))), runs


@dataclass
class Automaton:
    """next[state][symbol] = [state, count]; ends[state] = count of strings that end there."""

    next: list[dict] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [0])

    def add(self, symbols: str) -> None:
        s = 0
        for c in symbols:
            if c not in self.next[s]:
                self.next.append({})
                self.ends.append(0)
                self.next[s][c] = [len(self.next) - 1, 0]
            self.next[s][c][1] += 1
            s = self.next[s][c][0]
        self.ends[s] += 1

    def total(self, s: int) -> int:
        return self.ends[s] + sum(n for _, n in self.next[s].values())

    def alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether no frequency of the two states, or of what follows both, differs by more than Hoeffding's bound."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = self.total(p), self.total(q)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (n**-0.5 + m**-0.5)
            if abs(self.ends[p] / n - self.ends[q] / m) > bound:
                return False
            for c in self.next[p].keys() | self.next[q].keys():
                x, y = self.next[p].get(c, (None, 0)), self.next[q].get(c, (None, 0))
                if abs(x[1] / n - y[1] / m) > bound:
                    return False
                if x[0] is not None and y[0] is not None and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Adds a subtree's counts to a state and what follows it."""
        todo = [(into, tree)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            for c, (to, n) in self.next[q].items():
                if c in self.next[p]:
                    self.next[p][c][1] += n
                    todo.append((self.next[p][c][0], to))
                else:
                    self.next[p][c] = [to, n]

    def logp(self, token: str) -> float | None:
        """Log probability of the token and its end; None if the automaton doesn't accept it."""
        s, out = 0, 0.0
        for c in token:
            k = _CLASS_OF.get(c, c)
            if k not in self.next[s]:
                return None
            to, n = self.next[s][k]
            out += math.log(n / self.total(s) / _SIZE.get(k, 1))
            s = to
        return out + math.log(self.ends[s] / self.total(s)) if self.ends[s] else None


def infer(strings: list[str], alpha: float = 0.05) -> Automaton:
    """The automaton of the strings: red states are final, blue ones are merged into the first alike or turn red."""
    out = Automaton()
    for s in strings:
        out.add("".join(_CLASS_OF.get(c, c) for c in s))
    red = [0]
    while True:
        blue = sorted({(to, r, c) for r in red for c, (to, _) in out.next[r].items() if to not in red})
        if not blue:
            return out
        tree, parent, symbol = blue[0]
        for r in red:
            if out.alike(r, tree, alpha):
                out.next[parent][symbol][0] = r
                out.fold(r, tree)
                break
        else:
            red.append(tree)


@dataclass
class Table:
    """An automaton as arrays by state and ASCII code: what follows (-1: nothing), and log probabilities of that and of the end."""

    next: np.ndarray
    step: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, a: Automaton) -> Table:
        to, step = np.full((len(a.next), 128), -1, dtype=np.int32), np.zeros((len(a.next), 128))
        end = np.full(len(a.next), -np.inf)
        for s, edges in enumerate(a.next):
            if total := a.total(s):
                end[s] = math.log(a.ends[s] / total) if a.ends[s] else -np.inf
                for k, (state, n) in edges.items():
                    for c in _CLASSES.get(k, k):
                        to[s, ord(c)], step[s, ord(c)] = state, math.log(n / total / _SIZE.get(k, 1))
        return cls(to, step, end)

    def logp(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of the tokens codes[start : start + size], all of them a character at a time; -inf where one isn't accepted."""
        out, state, live, at = np.zeros(len(starts)), np.zeros(len(starts), dtype=np.int32), np.arange(len(starts)), 0
        while len(live):
            done = sizes[live] == at
            out[live[done]] += self.end[state[live[done]]]
            live = live[~done]
            c, s = codes[starts[live] + at], state[live]
            out[live] += self.step[s, c]
            state[live] = self.next[s, c]
            out[live[state[live] < 0]] = -np.inf
            live, at = live[state[live] >= 0], at + 1
        return out


@dataclass(frozen=True)
class Grammar:
    """Automata by kind, log probabilities of the classes in ordinary tokens by form, and what a secret needs.

    margin: nats a character by which the best automaton must find a token likelier than ordinary ones of its form;
    evidence: nats in all, against the odds that a token is no secret. So a short token needs more a character.
    """

    automata: dict[str, Automaton]
    ordinary: dict[str, dict[str, float]]
    margin: float
    evidence: float = 4.8

    @cached_property
    def tables(self) -> list[Table]:
        return [Table.of(a) for a in self.automata.values()]

    @cached_property
    def usual(self) -> np.ndarray:
        """Log probability of each ASCII code by form."""
        out = np.zeros((len(_FORMS), 128))
        for i, form in enumerate(_FORMS):
            known = self.ordinary.get(form, {})
            floor = min(known.values(), default=-5.0)
            out[i] = [known.get(k := _CLASS_OF.get(chr(c), chr(c)), floor) - math.log(_SIZE.get(k, 1)) for c in range(128)]
        return out

    def gains(self, tokens: list[str]) -> np.ndarray:
        """The best automaton's log likelihood ratio of each token to ordinary tokens of its form; -inf if none accepts it."""
        codes = np.frombuffer("".join(tokens).encode("ascii"), dtype=np.uint8)
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        short, best = np.flatnonzero(sizes <= _LOCKSTEP), np.full(len(tokens), -np.inf)
        for table in self.tables:
            best[short] = np.maximum(best[short], table.logp(codes, starts[short], sizes[short]))
        for j in np.flatnonzero(sizes > _LOCKSTEP):
            best[j] = max((p for a in self.automata.values() if (p := a.logp(tokens[j])) is not None), default=-np.inf)
        letter, digit = (np.logical_or.reduceat(of[codes], starts) for of in (_IS_LETTER, _IS_DIGIT))
        form = np.where(letter, np.where(digit, 2, 1), 0)
        return best - np.add.reduceat(self.usual[np.repeat(form, sizes), codes], starts)

    def likelihood(self, token: str) -> float:
        """The ratio of gains(), a character."""
        return float(self.gains([token])[0]) / len(token)

    def secrets(self, tokens: list[str]) -> set[str]:
        """Those of the tokens that are likely enough."""
        if not tokens or not self.automata:
            return set()
        gain, size = self.gains(tokens), np.array([len(t) for t in tokens])
        return {tokens[j] for j in np.flatnonzero((gain >= self.margin * size) & (gain >= self.evidence))}

    def spans(self, text: str) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int, str, str]]]:
        """Base spans, and all spans."""
        return next(self.each([text]))

    def each(self, texts: Iterable[str], most_tokens: int = 200_000) -> Iterator[tuple[list, list]]:
        """spans() of each text; the distinct candidates of some texts are scored together."""
        held: list[tuple] = []
        tokens: set[str] = set()
        for text in texts:
            base, runs = base_spans(text)
            gaps = [list(_parts(text, *gap)) for gap in _gaps(text, runs, base)] if self.automata else []
            tokens.update(text[a:b] for gap in gaps for a, b in gap)
            held.append((text, base, gaps))
            if len(tokens) > most_tokens:
                yield from self._told(held, tokens)
                held, tokens = [], set()
        yield from self._told(held, tokens)

    def _told(self, held: list, tokens: set[str]) -> Iterator[tuple[list, list]]:
        secret = self.secrets(list(tokens))
        for text, base, gaps in held:
            more = []
            for gap in gaps if secret else ():
                reach = -1
                for a, b in sorted((x for x in gap if text[x[0] : x[1]] in secret), key=lambda x: (x[0], -x[1])):
                    if b > reach:  # not within a wider one
                        more.append((a, b, "format", text[a:b]))
                        reach = b
            yield base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _form(token: str) -> str:
    return "number" if not _LETTER.search(token) else "mixed" if _DIGIT.search(token) else "word"


def _bare(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The stretch without marks at its ends, if it is long enough."""
    while end > start and text[end - 1] in ".=-_/+":
        end -= 1
    while end > start and text[start] in ".=-_/+":
        start += 1
    if end - start >= _LEAST:
        yield start, end


def _gaps(text: str, runs: list[tuple[int, int]], base: list) -> Iterator[tuple[int, int]]:
    """What the base spans (sorted by start) leave of the runs, without marks at the ends; both are walked side by side."""
    k = 0
    for start, end in runs:
        while k < len(base) and base[k][0] < end:
            a, b = base[k][:2]
            if b > start:
                yield from _bare(text, start, a)
                start = b
            if b > end:  # it may reach into the next run, too
                break
            k += 1
        yield from _bare(text, start, end)


def _tokens(text: str, start: int, end: int, base: list) -> Iterator[tuple[int, int]]:
    """What the base spans leave of one run."""
    return _gaps(text, [(start, end)], base)


def _parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The candidates of a token, the widest first: itself, and its parts between the marks =, / and . of each choice."""
    found = {(start, end)}
    if not _MARKED.search(text, start, end):
        yield start, end
        return
    for cut in _CUTS:
        at = start
        for m in cut.finditer(text, start, end):
            found.update(_bare(text, at, m.start()))
            at = m.end()
        found.update(_bare(text, at, end))
    yield from sorted(found, key=lambda x: (x[0] - x[1], x))


def learn(df: DataFrame, text: str = "text", most_strings: int = 400, alpha: float = 0.05, margin: float = 0.3, evidence: float = 4.8) -> Grammar:
    """Learns from all texts: base matches label credentials, all other candidates stand for ordinary text.

    Automata are fitted on a bounded sample: of the distinct credentials of each kind those `most_strings` with the
    lowest hash. Classes are counted over all other candidates. A kind of fewer than 8 credentials gets no automaton.
    """
    fields = "kind string, value string, n bigint"

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(_FORMS), 256), dtype=np.int64)
        for part in batches:
            seen: set = set()
            for t in part["text"]:
                if not t:
                    continue
                base, runs = base_spans(t)
                seen.update((k, v) for *_, k, v in base)
                forms: dict[str, list[str]] = {f: [] for f in _FORMS}
                for a, b in _gaps(t, runs, base):
                    token = t[a:b]
                    forms[_form(token)].append(token)
                for i, tokens in enumerate(forms.values()):
                    counts[i] += np.bincount(np.frombuffer("".join(tokens).encode("ascii"), dtype=np.uint8), minlength=256)
            yield pd.DataFrame([(*x, 1) for x in sorted(seen)], columns=["kind", "value", "n"])
        yield pd.DataFrame([(f"{_FORMS[i]} characters", chr(c), counts[i, c]) for i, c in np.argwhere(counts)], columns=["kind", "value", "n"])

    rows = written(df.select(F.col(text).alias("text")).mapInPandas(found, fields).groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    samples = {k: [r[0] for r in rows.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(most_strings).select("value").collect()] for k in KINDS[:3]}
    counts: Counter = Counter()
    for r in rows.where(~F.col("kind").isin(*KINDS)).collect():  # forms x token characters at most
        counts[r["kind"].split()[0], _CLASS_OF.get(r["value"], r["value"])] += r["n"]
    ordinary = {}
    for form in _FORMS:
        n = {c: counts[form, c] + 20 for c in ("d", "x", "l", "X", "U", *"+/_.=-") if (c != "d" or form != "word") and (c not in "xlXU" or form != "number")}
        ordinary[form] = {c: math.log(k / sum(n.values())) for c, k in n.items()}
    return Grammar({k: infer(samples[k], alpha) for k in KINDS[:3] if len(samples[k]) >= 8}, ordinary, margin, evidence)


def _digest(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", grammar: Grammar | None = None, **learning) -> DataFrame:
    """One row per input row: id_col, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points).

    Null and empty texts have no spans and the digest of nothing; repeated rows stay; an empty table gives an empty
    result; other columns are not returned. The grammar is learned from the same texts if none is given.
    """
    grammar = grammar or learn(df, text, **learning)
    sent = df.sparkSession.sparkContext.broadcast(grammar)  # at most most_strings strings a kind

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for base, spans in sent.value.each(t or "" for t in texts):
                n = Counter(s[2] for s in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return df.select(F.col(id_col), found(F.col(text)).alias("f")).select(id_col, "f.*")


def redact(df: DataFrame, text: str = "text", grammar: Grammar | None = None, mark: str = "[SECRET]", **learning) -> DataFrame:
    """df with each span in text (overlaps joined) replaced by the mark; null texts stay null, columns as in df."""
    grammar = grammar or learn(df, text, **learning)
    sent = df.sparkSession.sparkContext.broadcast(grammar)

    def clean(t: str | None, spans: list) -> str | None:
        if not t or not spans:
            return t
        out, at = [], 0
        for start, end, *_ in spans:
            if start >= at:
                out += [t[at:start], mark]
            at = max(at, end)
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([clean(t, found[1]) for t, found in zip(texts, sent.value.each(t or "" for t in texts))], dtype=object)

    return df.withColumn(text, cleaned(F.col(text)))
