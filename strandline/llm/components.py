"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.staging import staged


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(arcs: DataFrame, moved: bool) -> DataFrame:
    """Link the neighbours of every ``u`` to the least of them and ``u``. ``moved``: only
    neighbours above ``u`` (their own smaller ones are linked from the other side)."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    linked = arcs.join(least, "u")
    if moved:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v): ``root`` is the least node it reaches.

    Each round is a large star and a small star, which keep reachability; a fixed point is one
    star per component. The number of edges never grows. Rounds are cut by a written table.
    Loops and repeated edges are allowed; nodes must be comparable and not NULL.
    """
    edges = staged(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = _star(_both_ways(edges), moved=True)
        edges = staged(_star(large, moved=False))
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
