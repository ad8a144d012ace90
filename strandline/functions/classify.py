"""Exceedance flags, concentration classes, sample types, ordered categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import column, not_nan
from strandline.model import (
    CLASS_LABELS,
    CLASS_LABELS_INCLUSIVE,
    TWO_CLASS_LABELS,
    Limits,
)

VALUE = "ENTEROCOCCI"


def routine() -> Column:
    """Neither a follow-up nor an off-schedule sample."""
    return ~F.col("RESAMPLE") & ~F.col("OTHER")


def above(x: str | Column, limit: float) -> Column:
    """1 above the limit, 0 at or below it, NULL when unknown."""
    return (not_nan(x) > limit).cast("int")


def add_flags(df: DataFrame, x: str = VALUE, limits: Limits = Limits()) -> DataFrame:
    """GT_104, GT_70 and BW_70_104 (above the low limit but not the high one) as 0/1."""
    high, low = above(x, limits.high), above(x, limits.low)
    return df.withColumns({"GT_104": high, "GT_70": low, "BW_70_104": low * (1 - high)})


def class_of(
    x: str | Column, limits: Limits = Limits(), labels: Sequence[str] = CLASS_LABELS
) -> Column:
    """Three classes; everything not above the low limit, zero included, is the lowest."""
    value = not_nan(x)
    return (
        F.when(value > limits.high, labels[2])
        .when(value > limits.low, labels[1])
        .when(value.isNotNull(), labels[0])
    )


def two_class_of(
    x: str | Column, limits: Limits = Limits(), labels: Sequence[str] = TWO_CLASS_LABELS
) -> Column:
    """Two classes; a value equal to the high limit is in the lower one."""
    value = not_nan(x)
    return F.when(value > limits.high, labels[1]).when(value.isNotNull(), labels[0])


def class_by_sum(
    low_flag: str | Column = "GT_70",
    high_flag: str | Column = "GT_104",
    labels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> Column:
    """The class whose index is the number of limits exceeded."""
    exceeded = column(low_flag) + column(high_flag)
    return F.get(F.array(*[F.lit(label) for label in labels]), exceeded)


def cut(x: str | Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals ``(breaks[i], breaks[i+1]]``; outside them NULL."""
    value = not_nan(x)
    bins = list(zip(breaks[:-1], breaks[1:], labels, strict=True))
    (lo, hi, label), *rest = bins
    out = F.when((value > lo) & (value <= hi), label)
    for lo, hi, label in rest:
        out = out.when((value > lo) & (value <= hi), label)
    return out


def binned_class_of(
    x: str | Column, limits: Limits = Limits(), labels: Sequence[str] = CLASS_LABELS
) -> Column:
    """Classes by interval from zero: unlike :func:`class_of`, zero or less has none."""
    return cut(x, (0.0, limits.low, limits.high, float("inf")), labels)


def sample_type() -> Column:
    """A sample flagged both ways counts as a resample."""
    return (
        F.when(F.col("RESAMPLE"), "Resample")
        .when(F.col("OTHER"), "Irregular")
        .otherwise("Routine")
    )


def add_sample_type(df: DataFrame) -> DataFrame:
    return df.withColumn("SAMPLE_TYPE", sample_type())


def as_ordered(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """Null out undeclared values and add ``<col>_LEVEL``, the 1-based level index."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col))
    return df.withColumns(
        {
            col: F.when(F.col(col).isin(*levels), F.col(col)),
            f"{col}_LEVEL": F.when(position > 0, position.cast("int")),
        }
    )


def harmonise(df: DataFrame) -> DataFrame:
    """One rainfall figure (inches in 48 hours) and one past-weather column."""
    return df.withColumns(
        {
            "ACCUMULATION": F.coalesce(F.col("ACCUMULATION_24HR") * 2, F.col("ACCUMULATION_48HR")),
            "PAST_WEATHER": F.coalesce(F.col("PAST_WEATHER_24HR"), F.col("PAST_WEATHER_48HR")),
        }
    )


def cap(x: str | Column, hi: float) -> Column:
    """Values above ``hi`` become ``hi``; NULL stays NULL."""
    value = column(x)
    return F.when(value > hi, F.lit(hi)).otherwise(value)


def override(
    df: DataFrame, rules: Sequence[Mapping[str, object]], col: str, value: object
) -> DataFrame:
    """Set ``col`` to ``value`` on rows that match every field of some rule."""
    matches = reduce(
        or_, [reduce(and_, [F.col(k) == F.lit(v) for k, v in rule.items()]) for rule in rules]
    )
    return df.withColumn(
        col, F.when(F.coalesce(matches, F.lit(False)), F.lit(value)).otherwise(F.col(col))
    )


def decorate(
    df: DataFrame,
    x: str = VALUE,
    limits: Limits = Limits(),
    labels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> DataFrame:
    """Flags, class by flag sum and sample type: what every report table starts from."""
    flagged = add_flags(df, x, limits)
    return add_sample_type(flagged.withColumn("CLASS", class_by_sum(labels=labels)))
