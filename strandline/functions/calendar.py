"""Sunday-based calendar derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import column
from strandline.model import SEASON_WEEKS, WEEKDAYS


def calweek(c: str | Column) -> Column:
    """Week of the year, with weeks running Sunday to Saturday and 1 January in week 1.

    The date is moved right by the weekday offset of 1 January, so that seven-day
    blocks counted from the year's start fall on Sundays. Days pushed over the year's
    end would restart at 1, hence the correction in December.
    """
    day = F.to_date(column(c))
    offset = F.dayofweek(F.trunc(day, "YEAR")) - 1
    block = F.floor((F.dayofyear(F.date_add(day, offset)) - 1) / 7).cast("int") + 1
    return F.when((block == 1) & (F.month(day) == 12), block + 52).otherwise(block)


def weekday_label(c: str | Column) -> Column:
    # ``get`` rather than ``element_at``, which takes a NULL index for the last element.
    return F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), F.dayofweek(column(c)) - 1)


def weekday_index(c: str | Column) -> Column:
    """Level index of a weekday label, Sunday = 1; NULL for anything else."""
    position = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), column(c))
    return F.when(position > 0, position.cast("int"))


def in_season(c: str | Column, lo: int = SEASON_WEEKS[0], hi: int = SEASON_WEEKS[1]) -> Column:
    week = column(c)
    return F.when(week.between(lo, hi), week)


def add_calendar(
    df: DataFrame,
    ts: str = "SAMPLE_DATE",
    season: tuple[int, int] | None = SEASON_WEEKS,
) -> DataFrame:
    """Add YEAR, MONTH, WEEK (NULL out of season), WEEKDAY and DATE."""
    week = calweek(ts)
    if season is not None:
        week = in_season(week, *season)
    return df.withColumns(
        {
            "YEAR": F.year(ts),
            "MONTH": F.month(ts),
            "WEEK": week,
            "WEEKDAY": weekday_label(ts),
            "DATE": F.to_date(F.col(ts)),
        }
    )
