"""Tables behind an interactive station explorer, for one site or for all at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.classify import VALUE, binned_class_of, class_of, two_class_of
from strandline.model import (
    SEASON_WEEKS,
    STATION_INFO_LABELS,
    WEEKDAYS,
    Limits,
)
from strandline.operators.handover import written_once
from strandline.operators.reshape import record_as_rows

SITE = "SAMPLE_POINT_NAME"
# "three" is the nested test, "binned" the interval classes, which leave zero out.
CLASSIFIERS = {"three": class_of, "two": two_class_of, "binned": binned_class_of}
METRICS = ("COUNT", "FRAC_GT_SSM", "FRAC_GT_BAV", "FRAC_BAV_SSM", "MEDIAN", "GEOMEAN")


def explore(
    df: DataFrame, types: Sequence[str], value: str | None = None, site: str = SITE
) -> DataFrame:
    """Samples of the chosen types, of one site when ``value`` names it."""
    if not types:
        raise ValueError("select at least one sample type")
    chosen = df.filter(F.col("SAMPLE_TYPE").isin(*types))
    return chosen if value is None else chosen.filter(F.col(site) == value)


def calendar_cells(
    df: DataFrame,
    classes: str = "three",
    max_week: int | None = None,
    resamples: bool = True,
    x: str = VALUE,
    limits: Limits = Limits(),
    site: str = SITE,
) -> DataFrame:
    """One cell per sample: week, weekday, class and sample type.

    With ``max_week`` samples out of season drop out, as their week is unknown.
    """
    cells = df if resamples else df.filter(~F.col("RESAMPLE"))
    if max_week is not None:
        cells = cells.filter(F.col("WEEK") <= max_week)
    cls = CLASSIFIERS[classes](x, limits)
    return cells.select(site, "YEAR", "WEEK", "WEEKDAY", cls.alias("CLASS"), "SAMPLE_TYPE")


def calendar_full(
    cells: DataFrame,
    weeks: tuple[int, int] = SEASON_WEEKS,
    weekdays: Sequence[str] = WEEKDAYS,
    site: str = SITE,
) -> DataFrame:
    """All cells, and an empty one for each in-season week and weekday a site and year lacks.

    The cells are written once and read twice, so that what they come from is read once. They
    are not shuffled: a site and year only marks the places it has in a bitmap, which combines
    before the shuffle, and the places not marked are added.
    """
    cells = written_once(cells)
    places = [(w, d) for w in range(weeks[0], weeks[1] + 1) for d in weekdays]
    grid = F.array(
        *[F.struct(F.lit(w).alias("WEEK"), F.lit(d).alias("WEEKDAY")) for w, d in places]
    )
    day = F.array_position(F.array(*[F.lit(d) for d in weekdays]), F.col("WEEKDAY"))
    season = F.col("WEEK").between(*weeks) & (day > 0)
    place = ((F.col("WEEK") - weeks[0]) * len(weekdays) + day - 1).cast("int")
    bit = F.expr("shiftleft(1L, place % 63)")
    marks = [
        F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / 63) == k, bit)), F.lit(0)).alias(f"m{k}")
        for k in range(-(-len(places) // 63))
    ]
    had = (
        cells.select(site, "YEAR", F.when(season, place).alias("place"))
        .groupBy(site, "YEAR")
        .agg(*marks)
        .withColumn("marks", F.array(*[f"m{k}" for k in range(len(marks))]))
    )
    unmarked = F.filter(
        grid,
        lambda _, i: F.getbit(F.get("marks", F.floor(i / 63).cast("int")), i % 63) == 0,
    )
    missing = had.select(site, "YEAR", F.inline(unmarked))
    return cells.unionByName(missing, allowMissingColumns=True)


def time_series(
    df: DataFrame,
    classes: str = "three",
    x: str = VALUE,
    limits: Limits = Limits(),
    site: str = SITE,
    ts: str = "SAMPLE_DATE",
) -> DataFrame:
    return df.select(site, ts, x, CLASSIFIERS[classes](x, limits).alias("CLASS"))


def covariate_pairs(
    df: DataFrame,
    covariate: str,
    group: str | None = None,
    x: str = VALUE,
    limits: Limits = Limits(),
    site: str = SITE,
) -> DataFrame:
    """(covariate, value, class), and the grouping variable as FACET when one is named."""
    facet = [] if group is None else [F.col(group).alias("FACET")]
    return df.filter(F.col(covariate).isNotNull()).select(
        site,
        F.col(covariate).alias("COVARIATE"),
        x,
        binned_class_of(x, limits).alias("CLASS"),
        *facet,
    )


def map_metric(stations: DataFrame, stats: DataFrame, metric: str, site: str = SITE) -> DataFrame:
    """A station's colour value and the metric's range over all sites; shares in percent."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    factor = 100.0 if metric.startswith("FRAC") else 1.0
    ends = stats.agg(F.struct(F.min(metric).alias("lo"), F.max(metric).alias("hi"))).scalar()
    return stations.select(
        site,
        "LATITUDE",
        "LONGITUDE",
        (F.col(metric) * factor).alias("value"),
        (ends["lo"] * factor).alias("domain_lo"),
        (ends["hi"] * factor).alias("domain_hi"),
    )


def site_info(
    stations: DataFrame,
    labels: Mapping[str, str] = STATION_INFO_LABELS,
    value: str | None = None,
    site: str = SITE,
) -> DataFrame:
    """The station record with its statistics as (FIELD, VALUE) rows."""
    chosen = stations if value is None else stations.filter(F.col(site) == value)
    return record_as_rows(chosen, labels, [site])
