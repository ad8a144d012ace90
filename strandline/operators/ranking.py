"""Exact row numbers without bringing a whole group, or the whole table, to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.handover import CHUNK, POSITION, in_order
from strandline.operators.joins import null_safe_join


def row_numbers(
    df: DataFrame,
    order: Sequence[Column],
    partition: Sequence[str] = (),
    name: str = "row_number",
    size_name: str | None = None,
) -> DataFrame:
    """1-based position of each row in the total order ``order`` within ``partition``.

    Rows are range-partitioned and sorted on (partition, order), so a hot group spreads
    over many tasks. The sorted copy is written once, because the positions of a second
    evaluation could come from other range bounds. A row's number is then its place in
    its own range chunk plus the group's rows in earlier chunks. ``size_name`` adds the
    group's row count.
    """
    sort = [F.col(p).asc_nulls_last() for p in partition] + list(order)
    placed = in_order(df, sort)

    # At most (range chunks + groups) rows.
    chunks = placed.groupBy(*partition, CHUNK).agg(
        F.count(F.lit(1)).alias("__n"), F.min(POSITION).alias("__first")
    )
    by_group = W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))
    before = by_group.orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = chunks.withColumns(
        {
            "__before": F.coalesce(F.sum("__n").over(before), F.lit(0)),
            "__size": F.sum("__n").over(by_group),
        }
    ).drop("__n")
    if not partition:
        # One row per range chunk: bounded by the shuffle partition count.
        offsets = F.broadcast(offsets)

    numbered = null_safe_join(placed, offsets, [*partition, CHUNK])
    number = F.col(POSITION) - F.col("__first") + F.col("__before") + 1
    extra = [F.col("__size").alias(size_name)] if size_name else []
    return numbered.select(*df.columns, number.alias(name), *extra)


def rank_levels(
    df: DataFrame,
    cat: str,
    metric: str | Column,
    desc: bool = False,
    name: str = "level_rank",
) -> DataFrame:
    """Order the categories of a one-row-per-category table by a statistic.

    Equal statistics fall back on the category name, which makes the order total.
    """
    key = F.col(metric) if isinstance(metric, str) else metric
    first = key.desc_nulls_last() if desc else key.asc_nulls_last()
    return row_numbers(df, [first, F.col(cat).asc_nulls_last()], name=name)


def rank_by(
    df: DataFrame, metric: str, ties: Sequence[str] = ("SAMPLE_POINT_NAME",), k: int | None = None
) -> DataFrame:
    """Rows in descending order of a metric; the first ``k`` when asked for."""
    ranked = df.orderBy(F.col(metric).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties])
    return ranked if k is None else ranked.limit(k)
