"""Group size, share and total on each row: aggregate first, then attach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.joins import null_safe_join


def _with_group(df: DataFrame, group: Sequence[str], value: Column) -> DataFrame:
    # A window would bring each group to one task. The per-group table is joined instead: it
    # is broadcast when it turns out small, and else adaptive execution splits hot partitions.
    totals = df.groupBy(*group).agg(value.alias("__total"))
    return null_safe_join(df, totals, list(group), "left")


def with_group_count(df: DataFrame, group: Sequence[str], name: str = "n") -> DataFrame:
    return _with_group(df, group, F.count(F.lit(1))).withColumnRenamed("__total", name)


def with_group_total(
    df: DataFrame, group: Sequence[str], value: str = "N", name: str = "N_GROUP"
) -> DataFrame:
    return _with_group(df, group, F.sum(value)).withColumnRenamed("__total", name)


def with_group_share(
    df: DataFrame, group: Sequence[str], value: str = "N", name: str = "FRAC"
) -> DataFrame:
    out = _with_group(df, group, F.sum(value))
    return out.withColumn(name, F.try_divide(F.col(value), F.col("__total"))).drop("__total")
