"""Class shares by group, their cumulative curves, histograms, box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.classify import cap
from strandline.functions.text import not_nan
from strandline.model import CLASS_LABELS_INCLUSIVE
from strandline.operators.joins import null_safe_join
from strandline.operators.quantiles import quantiles_of_ranked, ranked_counts, value_counts
from strandline.operators.ranking import rank_levels, row_numbers
from strandline.operators.reshape import unpivot

VALUE = "ENTEROCOCCI"


#: Column of a class table that counts samples without a class.
UNKNOWN = "__unknown"


def _class_counts(cls: str, levels: Sequence[str]) -> list[Column]:
    return [
        *[F.count_if(F.col(cls) == v).alias(v) for v in levels],
        F.count_if(F.col(cls).isNull()).alias(UNKNOWN),
        F.count(F.lit(1)).alias("N_GROUP"),
    ]


def class_table(
    df: DataFrame,
    group: str | None = None,
    cls: str = "CLASS",
    levels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> DataFrame:
    """One row per group, or one of all: a zero-filled count column per class, one of samples
    without a class, and the number of all samples, N_GROUP."""
    return df.groupBy(*([] if group is None else [group])).agg(*_class_counts(cls, levels))


def class_tables(
    df: DataFrame,
    groups: Sequence[str],
    cls: str = "CLASS",
    levels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> DataFrame:
    """The class tables by each of ``groups``, and of all samples, from one pass: GROUPED_BY
    names the group, NULL for all."""
    by = F.coalesce(*[F.when(F.grouping(g) == 0, g) for g in groups]).alias("GROUPED_BY")
    sets = [*[[F.col(g)] for g in groups], []]
    return df.groupingSets(sets, *groups).agg(by, *_class_counts(cls, levels))


def table_of(tables: DataFrame, group: str | None = None) -> DataFrame:
    """One of :func:`class_tables`, as :func:`class_table` gives it."""
    own = tables.filter(F.col("GROUPED_BY").eqNullSafe(F.lit(group)))
    counts = tables.columns[tables.columns.index("GROUPED_BY") + 1 :]
    return own.select(*([] if group is None else [group]), *counts)


def _by_class(wide: DataFrame, keys: Sequence[str], levels: Sequence[str], value: str) -> DataFrame:
    """(keys, CLASS, value): a row per class, and one of CLASS NULL where samples lack one."""
    long = unpivot(wide, keys, [*levels, UNKNOWN], name="CLASS", value=value)
    known = F.when(F.col("CLASS") != UNKNOWN, F.col("CLASS"))
    return long.filter((F.col("CLASS") != UNKNOWN) | (F.col(value) > 0)).withColumn("CLASS", known)


def proportions(wide: DataFrame, levels: Sequence[str] = CLASS_LABELS_INCLUSIVE) -> DataFrame:
    """Share of each declared class, empty ones included, and of samples without one."""
    long = _by_class(wide, ["N_GROUP"], levels, "N")
    return long.select("CLASS", F.try_divide("N", "N_GROUP").alias("FREQ"))


def class_proportions(
    df: DataFrame, cls: str = "CLASS", levels: Sequence[str] = CLASS_LABELS_INCLUSIVE
) -> DataFrame:
    return proportions(class_table(df, None, cls, levels), levels)


def proportions_above(wide: DataFrame, levels: Sequence[str] = CLASS_LABELS_INCLUSIVE) -> DataFrame:
    """Class shares among samples above the low limit, thus in any class but the lowest."""
    above = wide.select(*[F.col(f"`{v}`") for v in levels[1:]])
    total = sum((F.col(f"`{v}`") for v in levels[2:]), F.col(f"`{levels[1]}`"))
    long = unpivot(above.withColumn("__all", total), ["__all"], levels[1:], name="CLASS", value="N")
    return long.filter("N > 0").select("CLASS", F.try_divide("N", "__all").alias("FREQ"))


def class_proportions_above(
    df: DataFrame,
    low: float,
    cls: str = "CLASS",
    x: str = VALUE,
    levels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> DataFrame:
    """Class shares among samples above ``low``; classes that cannot occur are left out."""
    return class_proportions(df.filter(not_nan(x) > low), cls, levels).filter(F.col("FREQ") > 0)


def class_counts_present(
    df: DataFrame,
    group: str,
    cls: str = "CLASS",
    levels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> DataFrame:
    """(group, CLASS, N, N_GROUP, FRAC) of the classes a group has, NULL among them; FRAC is
    within the group.

    All from one row per group, so the samples are read once and no group is gathered.
    """
    wide = class_table(df, group, cls, levels)
    long = _by_class(wide, [group, "N_GROUP"], levels, "N").filter(F.col("N") > 0)
    return long.withColumn("FRAC", F.try_divide("N", "N_GROUP"))


def _shares(wide: DataFrame, levels: Sequence[str]) -> DataFrame:
    return wide.withColumns({v: F.try_divide(F.col(f"`{v}`"), F.col("N_GROUP")) for v in levels})


def counts_filled(
    wide: DataFrame, group: str, levels: Sequence[str] = CLASS_LABELS_INCLUSIVE
) -> DataFrame:
    """Zero-filled counts per group and class; FRAC is of all samples of all groups.

    Groups are ordered by size.
    """
    ranked = rank_levels(wide, group, "N_GROUP", name="group_rank")
    everything = ranked.agg(F.sum("N_GROUP")).scalar()
    long = unpivot(ranked, [group, "N_GROUP", "group_rank"], levels, name="CLASS", value="N")
    return long.withColumn("FRAC", F.try_divide(F.col("N"), everything))


def class_counts_filled(
    df: DataFrame,
    group: str,
    cls: str = "CLASS",
    levels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> DataFrame:
    return counts_filled(class_table(df, group, cls, levels), group, levels)


def shares_filled(
    wide: DataFrame,
    group: str,
    order_class: str = ">104",
    levels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> DataFrame:
    """Zero-filled class shares within each group, groups ordered by one class's share."""
    shares = _shares(wide, levels)
    ranked = rank_levels(shares, group, F.col(f"`{order_class}`"), name="group_rank")
    return unpivot(ranked, [group, "group_rank"], levels, name="CLASS", value="FRAC")


def class_shares_filled(
    df: DataFrame,
    group: str,
    order_class: str = ">104",
    cls: str = "CLASS",
    levels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> DataFrame:
    return shares_filled(class_table(df, group, cls, levels), group, order_class, levels)


def share_of(
    wide: DataFrame,
    group: str,
    which: str = "70-104",
    levels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> DataFrame:
    """One class's share per group, zero where absent, groups ordered by it."""
    shares = _shares(wide, levels)
    one = shares.select(group, F.lit(which).alias("CLASS"), F.col(f"`{which}`").alias("FRAC"))
    return rank_levels(one, group, "FRAC", name="group_rank")


def class_share_of(
    df: DataFrame,
    group: str,
    which: str = "70-104",
    cls: str = "CLASS",
    levels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> DataFrame:
    return share_of(class_table(df, group, cls, levels), group, which, levels)


def share_cdf(
    df: DataFrame,
    group: str,
    cls: str = "CLASS",
    levels: Sequence[str] = CLASS_LABELS_INCLUSIVE,
) -> DataFrame:
    return cdf_of_shares(class_table(df, group, cls, levels), group, levels)


def cdf_of_shares(
    wide: DataFrame, group: str, levels: Sequence[str] = CLASS_LABELS_INCLUSIVE
) -> DataFrame:
    """Empirical distribution over groups of each class's share.

    A group without samples of a class takes no part in that class's curve.
    """
    long = unpivot(wide, [group, "N_GROUP"], levels, name="CLASS", value="N").filter("N > 0")
    shares = long.select(group, "CLASS", "N", F.try_divide("N", "N_GROUP").alias("FRAC"))
    placed = row_numbers(
        shares,
        [F.col("FRAC").asc(), F.col(group).asc_nulls_last()],
        partition=["CLASS"],
        name="__row",
        size_name="__rows",
    )
    return placed.select(
        group, "CLASS", "N", "FRAC", F.try_divide("__row", "__rows").alias("INDEX")
    )


def rank_curve(
    class_means: DataFrame, drop: Sequence[str] = (), site: str = "SAMPLE_POINT_NAME"
) -> DataFrame:
    """Sites of each class ranked by mean fraction, zero included; COMPLEMENT = 1 - FREQ."""
    kept = class_means.filter(~F.col("VAR").isin(*drop)) if drop else class_means
    placed = row_numbers(
        kept.select(site, "VAR", "MEAN_FRAC"),
        [F.col("MEAN_FRAC").asc_nulls_last(), F.col(site).asc_nulls_last()],
        partition=["VAR"],
        name="RANK",
        size_name="__rows",
    )
    freq = F.try_divide("RANK", "__rows")
    return placed.withColumns({"FREQ": freq, "COMPLEMENT": 1 - freq}).drop("__rows")


def _binned(value: Column, width: float, boundary: float) -> Column:
    """Number of the right-closed bin; bin k ends at ``boundary + k * width``."""
    return F.ceil((value - boundary) / width).cast("long")


def _edges(width: float, boundary: float) -> tuple[Column, Column]:
    hi = F.lit(float(boundary)) + F.col("bin") * F.lit(float(width))
    return (hi - F.lit(float(width))).alias("lo"), hi.alias("hi")


def histogram(
    df: DataFrame, x: str = VALUE, width: float = 10.0, boundary: float = 5.0, log10: bool = False
) -> DataFrame:
    """Counts in right-closed bins, on log10(x) when asked; then x must be positive."""
    value = not_nan(x)
    if log10:
        value = F.when(value > 0, F.log10(value))
    bins = df.select(_binned(value, width, boundary).alias("bin")).filter(F.col("bin").isNotNull())
    counted = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", *_edges(width, boundary), "n")


def capped_histogram(
    df: DataFrame,
    x: str = VALUE,
    hi: float = 400.0,
    width: float = 10.0,
    by: Sequence[str] = ("SAMPLE_POINT_NAME", "CLASS"),
) -> DataFrame:
    """Counts per bin of the capped value and per ``by`` (classes of the uncapped value)."""
    binned = df.select(*by, _binned(cap(not_nan(x), hi), width, 0.0).alias("bin"))
    counted = (
        binned.filter(F.col("bin").isNotNull())
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(*by, *_edges(width, 0.0), "n")


def _box_parts(df: DataFrame, group: Sequence[str], x: str, log10: bool) -> DataFrame:
    """Distinct values with counts, next to their group's quartiles."""
    if log10:
        df = df.filter(F.col(x) > 0).withColumn(x, F.log10(x))
    counts = ranked_counts(value_counts(df, group, x), group, x)
    quartiles = quantiles_of_ranked(counts, group, x, (0.25, 0.5, 0.75), ("q1", "median", "q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(x).between(F.col("q1") - reach, F.col("q3") + reach)
    return null_safe_join(counts.select(*group, x, "w"), quartiles.drop("n"), group).withColumn(
        "__inside", inside
    )


def box_stats(
    df: DataFrame,
    group: Sequence[str],
    x: str = VALUE,
    log10: bool = False,
    levels: Sequence[str] | None = None,
) -> DataFrame:
    """Quartiles and whiskers per group; whiskers end at the last values within 1.5 IQR.

    With ``levels`` the last group column is a category, and its unused levels appear
    with n = 0; samples outside the levels form the NULL category.
    """
    parts = _box_parts(df, group, x, log10)
    end = F.when(F.col("__inside"), F.col(x))
    stats = parts.groupBy(*group).agg(
        *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(end).alias("whisker_lo"),
        F.max(end).alias("whisker_hi"),
        F.sum("w").alias("n"),
    )
    return stats if levels is None else _with_all_levels(stats, group, levels)


def _with_all_levels(stats: DataFrame, group: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Add a box with n = 0 for each level a group lacks; a group has few boxes."""
    *outer, category = group
    cells = [c for c in stats.columns if c not in outer]
    types = dict(stats.dtypes)
    boxes = stats.groupBy(*outer).agg(F.collect_list(F.struct(*cells)).alias("boxes"))

    def empty(level: Column) -> Column:
        known = {category: level, "n": F.lit(0)}
        return F.struct(
            *[known.get(c, F.lit(None)).cast(types[c]).alias(c) for c in cells]
        )

    present = F.transform("boxes", lambda box: box[category])
    missing = F.array_except(F.array(*[F.lit(v) for v in levels]), present)
    return boxes.select(*outer, F.inline(F.concat("boxes", F.transform(missing, empty))))


def box_outliers(
    df: DataFrame, group: Sequence[str], x: str = VALUE, log10: bool = False
) -> DataFrame:
    """Values beyond the whiskers, each with the number of samples that have it."""
    outside = _box_parts(df, group, x, log10).filter(~F.col("__inside"))
    return outside.select(*group, x, F.col("w").alias("n"))
