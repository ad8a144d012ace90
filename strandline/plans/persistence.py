"""How often a follow-up sample still exceeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.classify import VALUE
from strandline.model import Limits
from strandline.operators.previous import with_previous
from strandline.operators.ranking import rank_by

SITE = "SAMPLE_POINT_NAME"


def with_previous_sample(
    df: DataFrame,
    x: str = VALUE,
    site: str = SITE,
    year: str = "YEAR",
    ts: str = "SAMPLE_DATE",
    id: str = "id",
) -> DataFrame:
    """The previous flag, value, class and resample mark within site and year.

    Must see every sample: a filter may only follow, or "previous" would change meaning.
    """
    cols = ["GT_104", x, "CLASS", "RESAMPLE"]
    return with_previous(df, [site, year], cols, ts, id)


def followups(
    previous: DataFrame,
    x: str = VALUE,
    limits: Limits = Limits(),
    max_gap: int = 3,
    initial_only: bool = False,
) -> DataFrame:
    """Resamples at most ``max_gap`` days after an exceedance.

    ``initial_only`` leaves out resamples of resamples.
    """
    pairs = previous.filter(
        F.col("RESAMPLE") & (F.col(f"PREV_{x}") > limits.high) & (F.col("DIFFTIME") <= max_gap)
    )
    return pairs.filter(~F.col("PREV_RESAMPLE")) if initial_only else pairs


def followup_pairs(pairs: DataFrame, x: str = VALUE, site: str = SITE) -> DataFrame:
    """Each resample's value against the previous one, with the gap in days."""
    resamples = pairs.filter(F.col("RESAMPLE"))
    return resamples.select(site, F.col(f"PREV_{x}").alias("PREV"), x, "CLASS", "DIFFTIME")


def repeat_exceedance_by_site(
    previous: DataFrame,
    gaps: Sequence[int] = (1, 2),
    min_support: int = 10,
    site: str = SITE,
) -> DataFrame:
    """Resamples ``gaps`` days after the previous sample: how many exceed, by site.

    Sites need more than ``min_support`` of them; worst first.
    """
    near = previous.filter(F.col("RESAMPLE") & F.col("DIFFTIME").isin(*gaps))
    counted = near.groupBy(site).agg(
        F.count(F.lit(1)).alias("N"), F.sum("GT_104").cast("long").alias("N_GT_104")
    )
    kept = counted.filter(F.col("N") > min_support)
    return rank_by(kept.withColumn("FRAC", F.try_divide("N_GT_104", "N")), "FRAC", [site])


def _exceeding(pairs: DataFrame, site: str) -> DataFrame:
    return pairs.groupBy(site).agg(
        F.count(F.lit(1)).alias("N_TOTAL"), F.sum("GT_104").cast("long").alias("N_EXCEED")
    )


def initial_resample_total(pairs: DataFrame, site: str = SITE) -> DataFrame:
    """All initial resamples of the programme and the share that still exceed."""
    totals = _exceeding(pairs, site).agg(
        F.sum("N_TOTAL").alias("N_TOTAL"), F.sum("N_EXCEED").alias("N_EXCEED")
    )
    return totals.withColumn("FRAC", F.try_divide("N_EXCEED", "N_TOTAL"))


def initial_resample_by_site(
    pairs: DataFrame, min_support: int = 10, site: str = SITE
) -> DataFrame:
    """As the total, for sites with more than ``min_support`` initial resamples."""
    kept = _exceeding(pairs, site).filter(F.col("N_TOTAL") > min_support)
    return rank_by(kept.withColumn("FRAC", F.try_divide("N_EXCEED", "N_TOTAL")), "FRAC", [site])
