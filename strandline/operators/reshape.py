"""Long/wide reshaping with declared column lists, so that no extra pass finds them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(*dfs: DataFrame) -> DataFrame:
    """All rows of all tables, duplicates kept, columns matched by name."""
    return reduce(DataFrame.unionByName, dfs)


def unique_cell(name_col: str, name: str, value: str | Column, row: Column | None = None) -> Column:
    """The single value of one pivot cell; evaluating a cell with two rows fails.

    Checking inside the same aggregate needs no second pass. With ``row``, a fingerprint
    of the whole row, exact copies count as one row and only different rows fail.
    """
    value = F.col(value) if isinstance(value, str) else value
    hit = F.col(name_col) == name
    if row is None:
        ambiguous = F.count_if(hit) > 1
    else:
        ambiguous = F.min(F.when(hit, row)) != F.max(F.when(hit, row))
    message = F.lit(f"more than one value for one key in column {name}")
    return F.when(ambiguous, F.raise_error(message)).otherwise(F.max(F.when(hit, value)))


def row_fingerprint(cols: Sequence[str]) -> Column:
    """A 64-bit hash of a row; the mask of NULLs is hashed too, as hashing skips them."""
    mask = reduce(
        lambda a, b: a + b,
        [F.col(f"`{c}`").isNull().cast("long") * (1 << i) for i, c in enumerate(cols)],
    )
    return F.xxhash64(mask, *[F.col(f"`{c}`") for c in cols])


def pivot_strict(
    df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]
) -> DataFrame:
    """One column per listed name; a second row for a (key, name) cell is an error.

    Rows with other names fill no column, but their keys appear; ``unlisted`` has them.
    """
    return df.groupBy(*keys).agg(*[unique_cell(name, n, value).alias(n) for n in names])


def unlisted(df: DataFrame, name: str, names: Sequence[str]) -> DataFrame:
    """Rows a strict pivot over ``names`` leaves out."""
    return df.filter(F.col(name).isNull() | ~F.col(name).isin(*names))


def pivot_fill(
    df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str], fill=0
) -> DataFrame:
    """As :func:`pivot_strict`, with ``fill`` where a key lacks a name."""
    return pivot_strict(df, keys, name, value, names).fillna(fill, subset=list(names))


def unpivot(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    drop_null: bool = False,
    name: str = "PARAMETER_NAME",
    value: str = "VALUE",
) -> DataFrame:
    """Columns to (name, value) rows; mixed column types must be cast by the caller."""
    long = df.unpivot(list(keys), list(cols), name, value)
    return long.filter(F.col(value).isNotNull()) if drop_null else long


def record_as_rows(
    df: DataFrame,
    labels: Mapping[str, str],
    keys: Sequence[str] = ("SAMPLE_POINT_NAME",),
    digits: int = 6,
) -> DataFrame:
    """Each record as (FIELD, VALUE) text rows under display labels."""
    types = dict(df.dtypes)

    def text(c: str) -> Column:
        col = F.round(c, digits) if types[c] == "double" else F.col(c)
        return col.cast("string")

    shown = df.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys],
        *[text(c).alias(label) for c, label in labels.items()],
    )
    fields = [f"`{label}`" for label in labels.values()]
    long = shown.unpivot([f"__key_{k}" for k in keys], fields, "FIELD", "VALUE")
    return long.withColumnsRenamed({f"__key_{k}": k for k in keys})
