"""Resample and off-schedule flags: from an edit log to columns on the samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.joins import null_safe_join


def assign_flags(
    df: DataFrame,
    resamples: DataFrame,
    others: DataFrame,
    id: str = "id",
    site: str = "SAMPLE_POINT_NAME",
) -> DataFrame:
    """Add RESAMPLE and OTHER by (id, point), NULL points match; absent from a list means false."""

    def flagged(flags: DataFrame, name: str) -> DataFrame:
        return flags.select(
            F.col("id").alias(id), F.col("stn").alias(site), F.lit(True).alias(name)
        )

    out = null_safe_join(df, flagged(resamples, "RESAMPLE"), [id, site], "left")
    out = null_safe_join(out, flagged(others, "OTHER"), [id, site], "left")
    return out.withColumns(
        {c: F.coalesce(F.col(c), F.lit(False)) for c in ("RESAMPLE", "OTHER")}
    ).select(*df.columns, "RESAMPLE", "OTHER")


def fold_ledger(edits: DataFrame) -> DataFrame:
    """The ids of each list whose last edit is an addition.

    ``edits`` has (list, step, id, stn, op) with op ``add`` or ``remove``.
    """
    last = edits.groupBy("list", "id").agg(
        F.max_by(F.struct("op", "stn"), F.col("step")).alias("last")
    )
    return last.filter(F.col("last.op") == "add").select("list", "id", "last.stn")
