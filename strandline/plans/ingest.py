"""Raw measurement rows to clean long rows: names, types, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import to_integer, to_number, trimmed
from strandline.model import RAW_DROPPED, RAW_RENAMES, RAW_TYPES
from strandline.operators.joins import KEY, as_one_key

_CONVERSIONS = {"number": to_number, "integer": to_integer, "trim": trimmed}


def standardise_names(
    df: DataFrame,
    drop: Sequence[int | str] = (),
    renames: Mapping[str, str] = RAW_RENAMES,
) -> DataFrame:
    """Drop columns by 0-based position or by name; blanks become underscores; rename."""
    dropped = {df.columns[d] if isinstance(d, int) else d for d in drop}
    kept = [c for c in df.columns if c not in dropped]

    def canonical(c: str) -> str:
        return renames.get(c.replace(" ", "_"), c.replace(" ", "_"))

    return df.select(*[F.col(f"`{c}`").alias(canonical(c)) for c in kept])


def standardise_types(df: DataFrame, spec: Mapping[str, str] = RAW_TYPES) -> DataFrame:
    """Convert the listed text columns; input that does not parse becomes NULL."""
    return df.withColumns({c: _CONVERSIONS[kind](c) for c, kind in spec.items()})


def dedup_rows(
    df: DataFrame, by: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """Whole-row distinct; copies combine before the shuffle.

    With ``by``, these columns become one, see :func:`as_one_key`, and rows are dealt by it, into
    ``tasks`` if given. Groups and joins on it then need no further shuffle. Copies meet behind
    the shuffle only.
    """
    if not by:
        return df.distinct()
    keyed = as_one_key(df, by)
    return keyed.repartition(*([tasks] if tasks else []), KEY).distinct()


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct known values of a column."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def typed_rows(raw: DataFrame, drop: Sequence[int | str] = RAW_DROPPED) -> DataFrame:
    """Names and types; copies stay, for consumers that combine them anyway."""
    return standardise_types(standardise_names(raw, drop))


def standardise(
    raw: DataFrame,
    drop: Sequence[int | str] = RAW_DROPPED,
    by: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Names, then types, then duplicates; ``by`` and ``tasks`` as in :func:`dedup_rows`."""
    return dedup_rows(typed_rows(raw, drop), by, tasks)
