"""Joins in which NULL keys match each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Several key columns as one.
KEY = "__key"


def as_one_key(df: DataFrame, keys: Sequence[str], name: str = KEY) -> DataFrame:
    """``keys`` as one column, a struct that is never NULL and equal where all of them are, NULLs
    included.

    Rows dealt by it stay where they are for groups and null-safe joins on it: by several keys,
    Spark deals both sides of such a join again, as it replaces their NULLs.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.struct(*keys).alias(name), *rest)


def as_columns(df: DataFrame, name: str = KEY) -> DataFrame:
    """Undoes :func:`as_one_key`."""
    return df.select(f"{name}.*", *[c for c in df.columns if c != name])


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join on ``keys`` with NULL equal to NULL; the keys appear once."""
    renamed = {k: f"__right_{k}" for k in keys}
    other = right.withColumnsRenamed(renamed)
    known = {k: not (left.schema[k].nullable or right.schema[k].nullable) for k in keys}
    # A null-safe comparison, even of a key that is never NULL, has both sides dealt again.
    condition = reduce(
        and_,
        [
            F.col(k) == F.col(r) if known[k] else F.col(k).eqNullSafe(F.col(r))
            for k, r in renamed.items()
        ],
    )
    joined = left.join(other, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full_outer", "full", "outer", "right", "right_outer"):
        merged = [F.coalesce(F.col(k), F.col(renamed[k])).alias(k) for k in keys]
    else:
        merged = [F.col(k) for k in keys]
    rest = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return joined.select(*merged, *rest)


def members(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose id is listed."""
    return df.join(ids.select(id), id, "left_semi")


def non_members(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose id is not listed."""
    return df.join(ids.select(id), id, "left_anti")
