"""Column helpers for word arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), 0)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def split_words(text: Column, separators: str) -> Column:
    """The non-empty parts of ``text`` between matches of ``separators``; none if NULL."""
    parts = F.split(F.coalesce(text, F.lit("")), separators, -1)
    return F.filter(parts, lambda w: w != "")


def positions(count: Column) -> Column:
    """0 .. count - 1; empty if count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )


def gram_hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(size)])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has a column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out
