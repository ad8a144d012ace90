"""Exact interpolated quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task's memory. Here distinct values
are counted, combined before the shuffle, and put in order once, in range chunks. Running totals
of the weights within a chunk, plus what earlier chunks hold of its first group, give each value
the ranks it covers.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.text import not_nan
from strandline.operators.handover import CHUNK, POSITION, in_order

#: Of a value with its weight ``w``: the first rank it covers, counted from 0, and the weight of
#: its whole group.
START, TOTAL = "__start", "__total"


def value_counts(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """(group, x, w): how often each known value occurs. Combines before the shuffle."""
    return (
        df.filter(F.col(x).isNotNull())
        .select(*group, not_nan(x).cast("double").alias(x))
        .filter(F.col(x).isNotNull())
        .groupBy(*group, x)
        .agg(F.count(F.lit(1)).alias("w"))
    )


def ranked_counts(counts: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """(group, x, w, START, TOTAL) of :func:`value_counts`, from one copy in order.

    Only the first and the last group of a range chunk can go on in other chunks. Their sums,
    at most two rows a chunk, are all that is carried between chunks.
    """
    group = list(group)
    placed = in_order(counts, [F.col(c).asc_nulls_last() for c in [*group, x]])
    in_chunk, in_part = W.partitionBy(CHUNK), W.partitionBy(CHUNK, *group)
    parts = placed.groupBy(CHUNK, *group).agg(
        F.sum("w").alias("__w"), F.min(POSITION).alias("__lo"), F.max(POSITION).alias("__hi")
    )
    at_end = (F.col("__lo") == F.min("__lo").over(in_chunk)) | (
        F.col("__hi") == F.max("__hi").over(in_chunk)
    )
    by_group = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    earlier = by_group.orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        parts.withColumn("__at_end", at_end)
        .filter("__at_end")
        .select(
            F.col(CHUNK).alias("__in"),
            *[F.col(c).alias(f"__of_{c}") for c in group],
            F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("__before"),
            F.sum("__w").over(by_group).alias("__whole"),
        )
    )
    same = functools.reduce(
        Column.__and__,
        [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in group],
        F.col(CHUNK) == F.col("__in"),
    )
    so_far = in_part.orderBy(POSITION).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = placed.withColumns(
        {"__to": F.sum("w").over(so_far), "__here": F.sum("w").over(in_part)}
    ).join(F.broadcast(carried), same, "left")
    return running.select(
        *group,
        x,
        "w",
        (F.col("__to") - F.col("w") + F.coalesce("__before", F.lit(0))).alias(START),
        F.coalesce("__whole", "__here").alias(TOTAL),
    )


def _position(p: float) -> Column:
    return F.lit(float(p)) * (F.col(TOTAL) - 1)


def rank_values(x: str, probs: Sequence[float]) -> list[Column]:
    """Aggregates over ranked counts: the values at the ranks next to each quantile."""

    def at(i: int, side: int, rank: Column) -> Column:
        held = (rank >= F.col(START)) & (rank < F.col(START) + F.col("w"))
        return F.max(F.when(held, F.col(x))).alias(f"__q{i}_{side}")

    return [
        at(i, side, rounding(_position(p)).cast("long"))
        for i, p in enumerate(probs)
        for side, rounding in ((0, F.floor), (1, F.ceil))
    ]


def interpolated(n: str, probs: Sequence[float], names: Sequence[str]) -> list[Column]:
    """The quantiles from :func:`rank_values` and the group's weight ``n``, by linear
    interpolation at ``p * (n - 1)``."""
    out = []
    for i, (p, name) in enumerate(zip(probs, names, strict=True)):
        position = F.lit(float(p)) * (F.col(n) - 1)
        lo, hi = F.col(f"__q{i}_0"), F.col(f"__q{i}_1")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return out


def quantiles_of_ranked(
    ranked: DataFrame,
    group: Sequence[str],
    x: str,
    probs: Sequence[float],
    names: Sequence[str],
    n_name: str = "n",
) -> DataFrame:
    """One row per group: its weight and its quantiles."""
    ends = ranked.groupBy(*group).agg(F.sum("w").alias(n_name), *rank_values(x, probs))
    known = ends.filter(F.col(n_name).isNotNull())  # without groups: an empty table has none
    return known.select(*group, n_name, *interpolated(n_name, probs, names))


def group_quantiles(
    df: DataFrame,
    group: Sequence[str],
    x: str,
    probs: Sequence[float],
    names: Sequence[str],
) -> DataFrame:
    ranked = ranked_counts(value_counts(df, group, x), group, x)
    return quantiles_of_ranked(ranked, group, x, probs, names)
