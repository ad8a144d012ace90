"""Station dimension, its joins, and the week spine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.calendar import calweek
from strandline.functions.geo import add_latlon
from strandline.operators.joins import null_safe_join

STATION_COLUMNS = (
    "SITE_SEQUENCE_NUMBER", "TOWN", "SITE_NAME", "SAMPLE_POINT_NAME",
    "SITE_LATITUDE_UTM", "SITE_LONGITUDE_UTM",
)


def station_rows(typed: DataFrame) -> DataFrame:
    """Distinct planar station rows of the measurements."""
    return typed.select(*STATION_COLUMNS).distinct()


def build_stations(typed: DataFrame, zone: int = 19) -> DataFrame:
    return add_latlon(station_rows(typed), zone=zone)


def attach_station(
    df: DataFrame, stations: DataFrame, point: str = "SAMPLE_POINT_NAME", beach: str = "SITE_NAME"
) -> DataFrame:
    """Left join to the distinct (point, town, beach); several such rows fan out, NULL points match.

    The station table is read by size: a broadcast when small, else a shuffle join.
    """
    names = stations.select(point, "TOWN", F.col("SITE_NAME").alias(beach)).distinct()
    return null_safe_join(df, names, [point], "left")


def station_stats_dim(
    stations: DataFrame, stats: DataFrame, point: str = "SAMPLE_POINT_NAME"
) -> DataFrame:
    """Stations with their site statistics; NULLs for stations without samples."""
    return null_safe_join(stations, stats, [point], "left")


def week_spine(years: DataFrame, lo: int = 23, hi: int = 36, year: str = "YEAR") -> DataFrame:
    """The weeks of each year in ``years``: first day and its label, weeks lo..hi.

    ``label_rank`` orders the labels by date within the year.
    """
    first, last = F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))
    days = years.select(year).distinct().withColumn("DATE", F.explode(F.sequence(first, last)))
    weeks = (
        days.withColumn("WEEK", calweek("DATE"))
        .groupBy(year, "WEEK")
        .agg(F.min("DATE").alias("START_DATE"))
        .filter(F.col("WEEK").between(lo, hi))
    )
    return weeks.select(
        year,
        "WEEK",
        "START_DATE",
        F.date_format("START_DATE", "MMM dd").alias("START_LABEL"),
        (F.col("WEEK") - lo + 1).alias("label_rank"),
    )


def attach_weeks(df: DataFrame, spine: DataFrame, year: str = "YEAR") -> DataFrame:
    """Left join of rows with YEAR and WEEK to the spine's week labels."""
    return df.join(spine.select(year, "WEEK", "START_DATE", "START_LABEL"), [year, "WEEK"], "left")


def station_choices(stations: DataFrame) -> DataFrame:
    """Menu labels "TOWN - BEACH - POINT", ordered by point."""

    def shown(c: str):
        return F.coalesce(F.col(c), F.lit("NA"))

    label = F.concat_ws(" - ", shown("TOWN"), shown("SITE_NAME"), shown("SAMPLE_POINT_NAME"))
    return stations.select("SAMPLE_POINT_NAME", label.alias("LABEL")).orderBy(
        "SAMPLE_POINT_NAME", "LABEL"
    )
