"""Column functions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(name: Column) -> Column:
    """Lower-case; other characters than letters, digits, `_`, `.` and `-` become `_`; trimmed; empty is null."""
    out = F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9_.-]+", "_")
    return F.nullif(F.regexp_replace(out, r"^[._-]+|[._-]+$", ""), F.lit(""))


def intent_key(name: Column) -> Column:
    """The form in which intent names are looked up."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")


def display_name(label: Column) -> Column:
    """`button::003::left_hand` and `intent::left_hand` as `Left hand`."""
    last = F.element_at(F.split(label, "::"), -1)
    return F.concat(F.upper(F.substring(last, 1, 1)), F.substring(F.replace(last, F.lit("_"), F.lit(" ")), 2, 1 << 30))


def button_label(index: Column, name: Column) -> Column:
    return F.concat(F.lit("button::"), F.lpad(index.cast("string"), 3, "0"), F.lit("::"), name)


def button_parts(label: Column) -> tuple[Column, Column]:
    """Index and name; a name may hold `::`."""
    parts = F.split(label, "::", 3)
    return F.element_at(parts, 2).cast("int"), F.element_at(parts, 3)


def intent_map(text: Column) -> Column:
    """`action=intent,action=intent` as a map, blanks trimmed; a repeated action raises at run time."""
    pairs = F.transform(F.split(text, ","), lambda p: F.split(p, "=", 2))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]), intent_key(p[1]))))


def inverse_map(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def task_set_key(ordered: Column) -> Column:
    """Stable key of a set of intents that are in canonical order: a readable part and 8 digits of SHA-1."""
    n = F.size(ordered)
    readable = F.when(n <= 3, F.array_join(ordered, "-")).otherwise(F.concat(n.cast("string"), F.lit("-intents")))
    return F.concat_ws("-", readable, F.substring(F.sha1(F.array_join(ordered, "|")), 1, 8))


def crop_or_pad(signal: Column, n: int) -> Column:
    """The first n samples; a shorter signal repeats its last one."""
    pad = F.array_repeat(F.element_at(signal, -1), F.greatest(F.lit(0), F.lit(n) - F.size(signal)))
    return F.when(F.size(signal) >= n, F.slice(signal, 1, n)).otherwise(F.concat(signal, pad))


def pick_channels(signal: Column, channels: list[int]) -> Column:
    """Some channels, in the given order; one out of range raises at run time."""
    return F.array(*[F.element_at(signal, c + 1) for c in channels])


def gate(command: Column, confidence: Column, threshold: Column | float) -> Column:
    """The command, or null below the threshold (equality passes)."""
    return F.when(confidence >= threshold, command)


def hybrid(blink: Column, ssvep: Column, mi: Column) -> Column:
    """The first of the three that has a command."""
    return F.coalesce(F.when(blink, F.lit("BLINK")), ssvep, mi)


def code(command: Column, classes: list[str]) -> Column:
    """Class index; 2 for a blink, -1 for no action."""
    return reduce(lambda e, x: e.when(command == x[1], x[0]), enumerate(classes), F.when(command == "BLINK", 2).when(command.isNull(), -1))


def refresh_period(frequency: Column, refresh: float) -> Column:
    """Frames of a flicker cycle on a display: whole, two at least."""
    return F.greatest(F.lit(2), F.round(F.lit(refresh) / frequency)).cast("int")


def reasons(*flagged: tuple[Column, str]) -> Column:
    """Names of the flags that hold, in the given order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in flagged]), lambda x: x.isNotNull())


def itr_bits(accuracy: Column, per_minute: Column, targets: int = 2) -> Column:
    """Wolpaw information transfer rate in bits a minute, not below zero."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), accuracy))
    bits = F.log2(F.lit(float(targets))) + p * F.log2(p) + (1 - p) * F.log2((1 - p) / max(1, targets - 1))
    return F.greatest(F.lit(0.0), bits * per_minute)


def log_variance(x: Column) -> Column:
    """Natural logarithm of a power, safe at zero."""
    return F.log(x + 1e-12)
