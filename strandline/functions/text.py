"""Tolerant conversion of text columns: bad input becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# fixed values: characters with the Unicode White_Space property
WHITESPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(c: str | Column) -> Column:
    """Strip all leading and trailing whitespace (plain ``trim`` would strip blanks only)."""
    return F.btrim(column(c), F.lit(WHITESPACE))


def not_nan(c: str | Column) -> Column:
    """NaN becomes NULL: Spark orders NaN above every number, so ``NaN > limit`` holds."""
    value = column(c)
    return F.when(~F.isnan(value), value)


def to_number(c: str | Column) -> Column:
    """Text to double; NaN and a Java-style type suffix such as ``12d`` give NULL.

    Most numbers end in a digit, which settles it without a pattern match.
    """
    text = column(c)
    value = text.try_cast("double")
    plain = F.right(text, F.lit(1)).between("0", "9")
    return F.when(plain | ~text.rlike(r"[0-9.][dDfF]\s*$"), F.nullif(value, F.lit(float("nan"))))


def to_integer(c: str | Column) -> Column:
    """Text to int, truncating a fraction: ``'12.0'`` and ``'12.9'`` give 12."""
    return to_number(c).try_cast("int")
