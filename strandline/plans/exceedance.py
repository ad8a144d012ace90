"""Exceedance counts by site, beach and year, and the cost of a lower limit.

All are grouped aggregates that combine before the shuffle. Medians here run over the
years of a site, a handful of rows; medians over samples use exact distributed quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.classify import above, add_flags, routine
from strandline.functions.text import not_nan
from strandline.model import SAMPLE_TYPES, Limits
from strandline.operators.joins import null_safe_join
from strandline.operators.quantiles import (
    interpolated,
    rank_values,
    ranked_counts,
    value_counts,
)
from strandline.operators.ranking import rank_by, rank_levels
from strandline.operators.reshape import unpivot

SITE, BEACH, VALUE = "SAMPLE_POINT_NAME", "SITE_NAME", "ENTEROCOCCI"


def _total(c: str) -> Column:
    return F.sum(c).cast("long")


def coverage_by_variable(
    wide: DataFrame, cols: Sequence[str], ts: str = "SAMPLE_DATE"
) -> DataFrame:
    """How many samples of each year know each variable; unknown ones are not counted.

    Counted wide and unpivoted afterwards, so rows do not multiply before the shuffle.
    """
    counted = wide.groupBy(F.year(ts).alias("YEAR")).agg(*[F.count(c).alias(c) for c in cols])
    return unpivot(counted, ["YEAR"], cols, value="n").filter(F.col("n") > 0)


def coverage_by_site(df: DataFrame, site: str = SITE, ts: str = "SAMPLE_DATE") -> DataFrame:
    return df.groupBy(site, F.year(ts).alias("YEAR")).agg(F.count(F.lit(1)).alias("n"))


def type_frequency(df: DataFrame, levels: Sequence[str] = SAMPLE_TYPES) -> DataFrame:
    """Samples per type, including types nobody has."""
    counted = df.agg(*[F.count_if(F.col("SAMPLE_TYPE") == v).alias(v) for v in levels])
    return unpivot(counted, [], levels, name="SAMPLE_TYPE", value="n")


def low_limit_by_site_year(
    df: DataFrame,
    site: str = SITE,
    year: str = "YEAR",
    x: str = VALUE,
    limits: Limits = Limits(),
) -> DataFrame:
    """Routine samples per site and year, and how many exceed only the lower limit."""
    flagged = add_flags(df.filter(routine()), x, limits)
    out = flagged.groupBy(site, year).agg(
        F.count(F.lit(1)).alias("N"),
        _total("GT_104").alias("N_GT_104"),
        _total("GT_70").alias("N_GT_70"),
        _total("BW_70_104").alias("N_BW_70_104"),
    )
    return out.withColumn("FRAC_BW_70_104", F.try_divide("N_BW_70_104", "N"))


def low_limit_by_site(by_year: DataFrame, site: str = SITE) -> DataFrame:
    """Spread over the years of the extra share, and extra resamples a year."""
    frac = "FRAC_BW_70_104"
    stats = by_year.groupBy(site).agg(
        F.min(frac).alias(f"MIN_{frac}"),
        F.max(frac).alias(f"MAX_{frac}"),
        F.avg(frac).alias(f"MEAN_{frac}"),
        F.median(frac).alias(f"MEDIAN_{frac}"),
        F.count(F.lit(1)).alias("N_YEAR"),
        _total("N").alias("N_SAMPLE"),
        F.avg("N").alias("MEAN_N_SAMPLE_PER_YEAR"),
        F.median("N").alias("MEDIAN_N_SAMPLE_PER_YEAR"),
    )
    mean_n, median_n = F.col("MEAN_N_SAMPLE_PER_YEAR"), F.col("MEDIAN_N_SAMPLE_PER_YEAR")
    return stats.withColumns(
        {
            "MEAN_N_RESAMPLE_PER_YEAR": F.col(f"MEAN_{frac}") * mean_n,
            "MEDIAN_N_RESAMPLE_PER_YEAR": F.col(f"MEDIAN_{frac}") * median_n,
            "MAX_N_RESAMPLE_PER_YEAR": F.col(f"MAX_{frac}") * mean_n,
        }
    )


def programme_totals(by_site: DataFrame) -> DataFrame:
    """Samples and extra resamples a year, summed over sites."""
    names = (
        "MEDIAN_N_SAMPLE_PER_YEAR",
        "MEAN_N_SAMPLE_PER_YEAR",
        "MEDIAN_N_RESAMPLE_PER_YEAR",
        "MEAN_N_RESAMPLE_PER_YEAR",
    )
    return by_site.agg(*[F.sum(c).alias(c) for c in names])


def class_counts_by_site_year(
    df: DataFrame,
    beach: str = BEACH,
    site: str = SITE,
    year: str = "YEAR",
    x: str = VALUE,
    limits: Limits = Limits(),
) -> DataFrame:
    """Routine samples per beach, site and year by class: counts and fractions."""
    flagged = df.filter(routine()).select(
        beach, site, year, above(x, limits.high).alias("hi"), above(x, limits.low).alias("lo")
    )
    counted = flagged.groupBy(beach, site, year).agg(
        F.count(F.lit(1)).alias("N"), _total("hi").alias("N_104"), _total("lo").alias("__lo")
    )
    classes = counted.withColumn("N_70", F.col("__lo") - F.col("N_104")).withColumn(
        "N_CLEAN", F.col("N") - F.col("N_104") - F.col("N_70")
    )
    shares = {f"F_{c}": F.try_divide(f"N_{c}", "N") for c in ("104", "70", "CLEAN")}
    return classes.drop("__lo").withColumns(shares)


def mean_exceedances_by_site(
    by_year: DataFrame, desc: bool = False, site: str = SITE
) -> DataFrame:
    """Mean yearly exceedances of each kind, sites ordered by their total."""
    means = by_year.groupBy(site).agg(
        F.avg("N_104").alias("MEAN_N_104"), F.avg("N_70").alias("MEAN_N_70")
    )
    total = means.withColumn("TOTAL", F.col("MEAN_N_104") + F.col("MEAN_N_70"))
    ranked = rank_levels(total, site, "TOTAL", desc)
    return unpivot(ranked, [site, "level_rank"], ["MEAN_N_104", "MEAN_N_70"], name="VARIABLE")


def mean_extra_by_site(by_year: DataFrame, site: str = SITE) -> DataFrame:
    """Mean yearly exceedances of the lower limit only, fewest first."""
    means = by_year.groupBy(site).agg(F.avg("N_70").alias("MEAN_N_70"))
    return means.orderBy(F.col("MEAN_N_70").asc_nulls_last(), F.col(site).asc_nulls_last())


def extra_by_year(by_year: DataFrame, year: str = "YEAR") -> DataFrame:
    """Exceedances of the lower limit only, newest year first."""
    return by_year.groupBy(year).agg(_total("N_70").alias("SUM_N_70")).orderBy(F.desc(year))


def mean_extra_total(by_year: DataFrame, site: str = SITE) -> DataFrame:
    """Mean yearly extra exceedances, summed over sites."""
    means = by_year.groupBy(site).agg(F.avg("N_70").alias("MEAN_N_70"))
    return means.agg(F.sum("MEAN_N_70").alias("SUM"))


def class_means_by_site(by_year: DataFrame, site: str = SITE) -> DataFrame:
    """Per site and class: samples, mean yearly count and mean yearly fraction."""
    classes = ("N_CLEAN", "N_70", "N_104")
    means = by_year.groupBy(site).agg(
        _total("N").alias("N"),
        *[
            F.struct(
                F.avg(c).alias("MEAN_VALUE"), F.avg(F.try_divide(c, "N")).alias("MEAN_FRAC")
            ).alias(c)
            for c in classes
        ],
    )
    long = means.unpivot([site, "N"], list(classes), "VAR", "m")
    return long.select(site, "VAR", "N", "m.MEAN_VALUE", "m.MEAN_FRAC")


def site_statistics(
    df: DataFrame, site: str = SITE, x: str = VALUE, limits: Limits = Limits()
) -> DataFrame:
    """Per site, over all sample types: count, shares, median and geometric mean.

    Everything comes from one pass over the site's distinct values with counts and ranks. The middle share
    excludes both limits. The geometric mean is 0 with a zero and NULL with a negative.
    """
    counts = ranked_counts(value_counts(df, [site], x), [site], x)
    value, weight = F.col(x), F.col("w")

    def share(condition: Column) -> Column:
        return F.try_divide(F.sum(F.when(condition, weight).otherwise(0)), F.sum(weight))

    geomean = (
        F.when(F.min(x) < 0, F.lit(None).cast("double"))
        .when(F.min(x) == 0, F.lit(0.0))
        .otherwise(F.exp(F.sum(F.ln(value) * weight) / F.sum(weight)))
    )
    stats = counts.groupBy(site).agg(
        F.sum(weight).alias("COUNT"),
        share(value > limits.high).alias("FRAC_GT_SSM"),
        share(value > limits.low).alias("FRAC_GT_BAV"),
        share((value > limits.low) & (value < limits.high)).alias("FRAC_BAV_SSM"),
        geomean.alias("GEOMEAN"),
        *rank_values(x, [0.5]),
    )
    shown = [site, "COUNT", "FRAC_GT_SSM", "FRAC_GT_BAV", "FRAC_BAV_SSM", "GEOMEAN"]
    return stats.select(*shown, *interpolated("COUNT", [0.5], ["MEDIAN"]))

