"""The previous row of each site in time order, without bringing a site to one task."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.handover import CHUNK, PLACE, POSITION, in_order


def with_previous(
    df: DataFrame,
    partition: Sequence[str],
    cols: Sequence[str],
    ts: str = "SAMPLE_DATE",
    id: str = "id",
) -> DataFrame:
    """Add PREV_<col> for each of ``cols`` and DIFFTIME, the whole days since then.

    The order within a group is (ts, id), NULLs last, as in a window by group. Rows are
    range-partitioned on (group, ts, id), whatever the groups' sizes: the only shuffle of the
    rows, as the ordered copy is read chunk by chunk. A row's predecessor is the one before it
    in its range chunk; a chunk's first row gets the last row of the chunk before. A predecessor
    of another group is none.
    """
    partition, wanted = list(partition), list(dict.fromkeys([*partition, *cols, ts]))
    sort = [F.col(c).asc_nulls_last() for c in [*partition, ts, id]]
    placed = in_order(df, sort)
    row = F.struct(*wanted)
    # One row per range chunk: bounded by the shuffle partition count.
    ends = placed.groupBy(CHUNK).agg(F.max_by(row, POSITION).alias("__end"))
    carried = ends.select(CHUNK, F.lag("__end").over(W.orderBy(CHUNK)).alias("__carried"))
    in_chunk = W.partitionBy(CHUNK).orderBy(POSITION)
    first = F.col(POSITION).bitwiseAND(F.lit(PLACE)) == 0
    joined = placed.withColumn("__lag", F.lag(row).over(in_chunk)).join(
        F.broadcast(carried), CHUNK, "left"
    )
    before = joined.withColumn("__prev", F.when(first, F.col("__carried")).otherwise(F.col("__lag")))
    same = functools.reduce(
        Column.__and__,
        [F.col(p).eqNullSafe(F.col(f"__prev.`{p}`")) for p in partition],
        F.col("__prev").isNotNull(),
    )
    prev = lambda c: F.when(same, F.col(f"__prev.`{c}`"))
    days = F.date_diff(F.to_date(F.col(ts)), F.to_date(prev(ts)))
    return before.select(
        *df.columns, *[prev(c).alias(f"PREV_{c}") for c in cols], days.alias("DIFFTIME")
    )
