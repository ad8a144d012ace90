"""Integrity checks. Each returns its violations; ``assert_empty`` turns them into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.calendar import calweek
from strandline.functions.classify import above
from strandline.model import SAMPLE_KEYS, Limits
from strandline.operators.groups import with_group_count
from strandline.operators.joins import null_safe_join
from strandline.operators.previous import with_previous


class CheckFailed(AssertionError):
    """A check found violations."""


def assert_empty(violations: DataFrame, what: str = "check", show: int = 5) -> None:
    examples = violations.take(show)
    if examples:
        raise CheckFailed(f"{what}: " + "; ".join(str(row.asDict()) for row in examples))


def ambiguous_stations(
    stations: DataFrame,
    point: str = "SAMPLE_POINT_NAME",
    site: str = "SITE_NAME",
    coords: Sequence[str] = ("SITE_LATITUDE_UTM", "SITE_LONGITUDE_UTM"),
) -> DataFrame:
    """Distinct station rows of points that have more than one."""
    counted = with_group_count(stations.distinct(), [point])
    return counted.filter(F.col("n") > 1).select(site, point, *coords, "n").orderBy(site, point)


def unmatched_keys(
    categorical: DataFrame, numeric: DataFrame, keys: Sequence[str] = SAMPLE_KEYS
) -> DataFrame:
    """Categorical rows without a numeric row."""
    return null_safe_join(categorical, numeric.select(*keys), keys, "left_anti")


def flagged_samples(
    flags: DataFrame, df: DataFrame, id: str = "id", point: str = "SAMPLE_POINT_NAME"
) -> DataFrame:
    """(id, sample_point) of the samples a list names: no larger than the list, but for copies.

    The list is the small side of the join, so the samples are only scanned.
    """
    samples = df.select(F.col(id).alias("id"), F.col(point).alias("sample_point"))
    return samples.join(flags.select("id"), "id", "left_semi")


def dangling_flags(flags: DataFrame, df: DataFrame, id: str = "id") -> DataFrame:
    """Flagged ids that no sample has."""
    return flags.join(flagged_samples(flags, df, id, id), "id", "left_anti").select("id", "stn")


def inconsistent_flags(
    flags: DataFrame, df: DataFrame, id: str = "id", point: str = "SAMPLE_POINT_NAME"
) -> DataFrame:
    """Ids flagged more than once, and flags whose point is not the sample's."""
    samples = flagged_samples(flags, df, id, point)
    joined = flags.select("id", F.col("stn").alias("flag_point")).join(samples, "id")
    differs = joined.filter(~F.col("flag_point").eqNullSafe(F.col("sample_point"))).withColumn(
        "reason", F.lit("point differs")
    )
    duplicate_flags = flags.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("stn").alias("flag_point")
    )
    duplicate_samples = samples.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.min("sample_point").alias("sample_point")
    )
    repeated = (
        duplicate_flags.join(duplicate_samples, "id")
        .filter((F.col("n") > 1) | (F.col("n_samples") > 1))
        .select("id", "flag_point", "sample_point", F.lit("duplicate").alias("reason"))
    )
    return differs.unionByName(repeated)


def flag_count_gap(flags: DataFrame, df: DataFrame, flag: str) -> DataFrame:
    """One row (expected, actual) when the flagged samples do not number the list's rows."""
    listed = flags.agg(F.count(F.lit(1)).alias("expected"))
    actual = df.agg(F.count_if(F.col(flag)).alias("actual")).scalar()
    return listed.withColumn("actual", actual).filter(F.col("expected") != F.col("actual"))


def multiple_per_day(
    df: DataFrame, site: str = "SAMPLE_POINT_NAME", ts: str = "SAMPLE_DATE"
) -> DataFrame:
    """Site and day pairs with more than one result."""
    days = df.groupBy(site, F.to_date(F.col(ts)).alias("DATE")).agg(F.count(F.lit(1)).alias("n"))
    return days.filter(F.col("n") > 1)


def resample_without_exceedance(
    df: DataFrame,
    site: str = "SAMPLE_POINT_NAME",
    ts: str = "SAMPLE_DATE",
    id: str = "id",
    x: str = "ENTEROCOCCI",
    limits: Limits = Limits(),
) -> DataFrame:
    """Resamples whose previous sample of the site, in any year, was not an exceedance.

    A resample with nothing before it is not a violation.
    """
    flagged = df.select(site, id, ts, "RESAMPLE", above(x, limits.high).alias("GT_104"))
    previous = with_previous(flagged, [site], ["GT_104"], ts, id)
    return previous.filter(F.col("RESAMPLE") & (F.col("PREV_GT_104") == 0)).select(
        site, id, ts, calweek(ts).alias("WEEK")
    )


def duplicate_cells(long: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Pivot cells with more than one row."""
    cells = long.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))
    return cells.filter(F.col("n") > 1)
