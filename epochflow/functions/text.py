"""Text for displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrapped(text: Column, width: int) -> Column:
    """The lines of a text: leading spaces go, and the running line is cut at the width, within words as well.

    An empty text is one empty line; null stays null.
    """
    body = F.ltrim(text)
    last = F.floor(F.greatest(F.length(body) - 1, F.lit(0)) / width).cast("int")
    return F.when(text.isNotNull(), F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(body, k * width + 1, F.lit(width))))


def tail(lines: Column, most: int) -> Column:
    """The last `most` lines."""
    n = F.size(lines)
    return F.slice(lines, F.greatest(n - most + 1, F.lit(1)), most)
