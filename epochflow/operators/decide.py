"""Sequential decisions: gated commands, selections and text, by folds over sorted partitions.

A session is read in order, row by row of Arrow batches, with its state carried along; it is never collected, so its
length doesn't matter. The transition functions are those of the streaming form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

LOCKOUT, BLINK, REJECTED, BUILDING, REFRACTORY, DISPATCHED = "LOCKOUT", "BLINK", "REJECTED", "BUILDING", "REFRACTORY", "DISPATCHED"


def fold_sorted(df: DataFrame, key: str, order: str, start: Callable, step: Callable, schema: str) -> DataFrame:
    """Applies step(state, row) -> output tuple to each row of a key in order, from start(); a row per row.

    step may return None for no output row. Rows are dealt by key and sorted within their partition.
    """
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (k := getattr(row, key)) != at:
                    at, state = k, start()
                if (got := step(state, row)) is not None:
                    out.append(got)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


@dataclass
class Decider:
    """State of one session: the run of equal commands, the lock after a blink, the last dispatch (None: never)."""

    run_label: str | None = None
    run: int = 0
    locked_until: float = float("-inf")
    last: float | None = None

    def step(self, now: float, command: str | None, artifact: bool, run: int = 3, lockout: float = 800, refractory: float = 1200) -> str:
        """The state after one window at `now` (ms); a null command is a rejected window."""
        if now < self.locked_until:
            self.run_label, self.run = None, 0
            return LOCKOUT
        if artifact:
            self.locked_until = now + lockout
            self.run_label, self.run = None, 0
            return BLINK
        if command is None or command != command:
            self.run_label, self.run = None, 0
            return REJECTED
        self.run_label, self.run = command, self.run + 1 if command == self.run_label else 1
        if self.run < run:
            return BUILDING
        if self.last is not None and now - self.last < refractory:
            return REFRACTORY  # the run goes on
        self.last, self.run_label, self.run = now, None, 0
        return DISPATCHED


def decide(df: DataFrame, run: int = 3, lockout: float = 800, refractory: float = 1200) -> DataFrame:
    """(session, n, t_ms, command, state) of windows (session, n, t_ms, command or null below the threshold, is_artifact)."""

    def step(d: Decider, r) -> tuple:
        return r.session, r.n, r.t_ms, r.command, d.step(r.t_ms, r.command, r.is_artifact, run, lockout, refractory)

    return fold_sorted(df.select("session", "n", "t_ms", "command", "is_artifact"), "session", "n", Decider, step, "session bigint, n bigint, t_ms bigint, command string, state string")


@dataclass
class Tree:
    """Halving of n ordered targets: left keeps the larger first half, right the rest."""

    n: int
    low: int = 0
    size: int = 0
    path: list = field(default_factory=list)

    def __post_init__(self):
        self.size = self.n

    def decide(self, left: bool) -> int | None:
        """The chosen target where one is left (then all are candidates again)."""
        self.path.append(left)
        first = (self.size + 1) // 2
        self.low, self.size = (self.low, first) if left else (self.low + first, self.size - first)
        if self.size > 1:
            return None
        chosen = self.low
        self.low, self.size, self.path = 0, self.n, []
        return chosen

    def undo(self) -> None:
        path = self.path[:-1]
        self.low, self.size, self.path = 0, self.n, []
        for left in path:
            self.decide(left)


@dataclass
class Scan:
    """Left moves the highlight on, right confirms it; the highlight stays where it is then."""

    n: int
    index: int = 0

    def decide(self, left: bool) -> int | None:
        if left:
            self.index = (self.index + 1) % self.n
            return None
        return self.index


def select(df: DataFrame, selector: Callable, targets: int) -> DataFrame:
    """(session, n, chosen) of decisions (session, n, is_left) through a Tree or a Scan; chosen is null while open."""

    def step(s, r) -> tuple:
        return r.session, r.n, s.decide(bool(r.is_left))

    out = "session bigint, n bigint, chosen bigint"
    return fold_sorted(df.select("session", "n", "is_left"), "session", "n", lambda: selector(targets), step, out)


BACKSPACE, SPACE, CLEAR, UNDO, SPEAK = "<BACKSPACE>", "<SPACE>", "<CLEAR>", "<UNDO>", "<SPEAK>"


@dataclass
class TextLog:
    """Text from a log of selections; the last `keep` states can be undone."""

    text: str = ""
    history: list = field(default_factory=list)
    keep: int = 64

    def accept(self, value: str | None) -> str:
        if value is None or value != value or value == SPEAK:
            return self.text
        if value == UNDO:
            self.text = self.history.pop() if self.history else self.text
            return self.text
        self.history = [*self.history[-(self.keep - 1) :], self.text]
        if value == BACKSPACE:
            self.text = self.text[:-1]
        elif value == CLEAR:
            self.text = ""
        elif value == SPACE:
            self.text += "" if not self.text or self.text.endswith(" ") else " "
        elif len(value) == 1 and value.isalpha():
            sentence = self.text.rstrip()
            self.text += value.upper() if not sentence or sentence[-1] in ".?!" else value.lower()
        else:
            self.text += value
        return self.text


def typed(df: DataFrame) -> DataFrame:
    """(session, n, text) after each selection of a log (session, n, value)."""
    return fold_sorted(df.select("session", "n", "value"), "session", "n", TextLog, lambda s, r: (r.session, r.n, s.accept(r.value)), "session bigint, n bigint, text string")
