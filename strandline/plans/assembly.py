"""Long measurement rows to one wide row per sample, with a stable id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.calendar import add_calendar
from strandline.functions.text import to_number
from strandline.model import (
    CATEGORICAL_NAMES,
    CATEGORY_RULES,
    NONDETECT_QUALIFIER,
    NUMERIC_NAMES,
    NUMERIC_RULES,
    SAMPLE_KEYS,
    SEASON_WEEKS,
    CategoryRule,
    NumericRule,
)
from strandline.operators.joins import null_safe_join
from strandline.operators.ranking import row_numbers
from strandline.operators.reshape import row_fingerprint, unique_cell

NAME = "PARAMETER_NAME"


def _selects_category(rule: CategoryRule) -> Column:
    name = F.col(NAME)
    test = name.contains(rule.contains)
    if rule.ends_with is None:
        return test
    ending = name.endswith(rule.ends_with)
    return test & (~ending if rule.negate_end else ending)


def _category_cells(rules: Sequence[CategoryRule]) -> list[Column]:
    """For each rule a (name, TEXT, NUMBER) cell, or NULL where the row does not match."""
    return [
        F.when(
            _selects_category(rule),
            F.struct(
                F.lit(rule.name).alias(NAME),
                F.replace(F.col(NAME), F.lit(rule.marker), F.lit("")).alias("TEXT"),
                F.lit(None).cast("double").alias("NUMBER"),
            ),
        )
        for rule in rules
    ]


def _cells(df: DataFrame, keys: Sequence[str], cells: Sequence[Column]) -> DataFrame:
    """One row per matching cell. Rules are independent: a row may match several."""
    # A filter after the generator stays in generated code; compacting the array would not.
    return df.select(*keys, F.inline(F.array(*cells))).filter(F.col(NAME).isNotNull())


def extract_categories(
    df: DataFrame,
    rules: Sequence[CategoryRule] = CATEGORY_RULES,
    keys: Sequence[str] = SAMPLE_KEYS,
) -> DataFrame:
    """(keys, PARAMETER_NAME, VALUE) for every rule a row matches, in one pass."""
    found = _cells(df, keys, _category_cells(rules))
    return found.select(*keys, NAME, F.col("TEXT").alias("VALUE"))


def substitute_nondetects(
    value: str | Column,
    qualifier: str = "CONCENTRATION_QUALIFIER",
    limit: str = "QUANITATION_LIMIT",
    token: str = NONDETECT_QUALIFIER,
) -> Column:
    """The quantitation limit where the qualifier says "not detected", else the value."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.coalesce(F.col(qualifier) == token, F.lit(False)), F.col(limit)).otherwise(value)


def _selects_numeric(rule: NumericRule) -> Column:
    test = F.lit(True)
    if rule.contains is not None:
        test = test & F.col(NAME).contains(rule.contains)
    if rule.names:
        test = test & F.col(NAME).isin(*rule.names)
    if rule.sample_type is not None:
        test = test & (F.col("SAMPLE_TYPE") == rule.sample_type)
    return test


def _numeric_name(rule: NumericRule) -> Column:
    if rule.rename_to is not None:
        return F.lit(rule.rename_to)
    name = F.col(NAME)
    for old, new in rule.recode.items():
        name = F.when(F.col(NAME) == old, new).otherwise(name)
    return name


def _numeric_cells(rules: Sequence[NumericRule]) -> list[Column]:
    measured = to_number("CONCENTRATION")
    return [
        F.when(
            _selects_numeric(rule),
            F.struct(
                _numeric_name(rule).alias(NAME),
                F.lit(None).cast("string").alias("TEXT"),
                (substitute_nondetects(measured) if rule.nondetect else measured).alias("NUMBER"),
            ),
        )
        for rule in rules
    ]


def extract_numeric(
    df: DataFrame,
    rules: Sequence[NumericRule] = NUMERIC_RULES,
    keys: Sequence[str] = SAMPLE_KEYS,
) -> DataFrame:
    """(keys, PARAMETER_NAME, VALUE double) for every rule a row matches, in one pass."""
    found = _cells(df, keys, _numeric_cells(rules))
    return found.select(*keys, NAME, F.col("NUMBER").alias("VALUE"))


def merge_variables(
    categorical: DataFrame, numeric: DataFrame, keys: Sequence[str] = SAMPLE_KEYS
) -> DataFrame:
    """Full outer merge of two wide tables, NULL keys matching; both sides stay whole.

    NUMERIC_ONLY marks rows without a categorical partner, for the order of ids.
    """
    marked = categorical.withColumn("__cat", F.lit(True))
    merged = null_safe_join(marked, numeric, keys, "full_outer")
    return merged.withColumn("NUMERIC_ONLY", F.col("__cat").isNull()).drop("__cat")


def widen(
    typed: DataFrame,
    keys: Sequence[str] = SAMPLE_KEYS,
    categorical: Sequence[str] = CATEGORICAL_NAMES,
    numeric: Sequence[str] = NUMERIC_NAMES,
) -> DataFrame:
    """Typed raw rows to wide rows with one scan and one shuffle.

    A single grouped pivot stands for whole-row dedup, two strict pivots and their full
    merge: each side has one row per key, grouping keeps NULL keys, and exact copies of
    a row share its fingerprint, so they combine map-side instead of being shuffled.
    A key whose cells all have unlisted names stays, with NULLs; see ``rejected_cells``.
    """
    cells = [*_category_cells(CATEGORY_RULES), *_numeric_cells(NUMERIC_RULES)]
    marked = typed.withColumn("__row", row_fingerprint(typed.columns))
    long = _cells(marked, [*keys, "__row"], cells)
    row = F.col("__row")
    return long.groupBy(*keys).agg(
        *[unique_cell(NAME, n, "TEXT", row).alias(n) for n in categorical],
        *[unique_cell(NAME, n, "NUMBER", row).alias(n) for n in numeric],
        (F.count_if(F.col(NAME).isin(*categorical)) == 0).alias("NUMERIC_ONLY"),
    )


def rejected_cells(
    typed: DataFrame,
    keys: Sequence[str] = SAMPLE_KEYS,
    categorical: Sequence[str] = CATEGORICAL_NAMES,
    numeric: Sequence[str] = NUMERIC_NAMES,
) -> DataFrame:
    """Distinct cells that match a rule but have no column: keys, name, text or number."""
    cells = [*_category_cells(CATEGORY_RULES), *_numeric_cells(NUMERIC_RULES)]
    found = _cells(typed, keys, cells)
    return found.filter(~F.col(NAME).isin(*categorical, *numeric)).distinct()


def assign_ids(
    df: DataFrame,
    site: str = "SAMPLE_POINT_NAME",
    sample: str = "DEP_SAMPLE_ID",
    ts: str = "SAMPLE_DATE",
    name: str = "id",
) -> DataFrame:
    """Number the merged samples.

    Samples with categorical data come first, by (point, sample id, date); then those
    with numeric data only, by (point, date, sample id).
    """
    order = [
        F.col("NUMERIC_ONLY").asc(),
        F.col(site).asc_nulls_last(),
        F.when(~F.col("NUMERIC_ONLY"), F.col(sample)).asc_nulls_last(),
        F.col(ts).asc_nulls_last(),
        F.col(sample).asc_nulls_last(),
    ]
    return row_numbers(df, order, name=name)


def build_samples(
    typed: DataFrame, season: tuple[int, int] | None = SEASON_WEEKS, result: str = "ENTEROCOCCI"
) -> DataFrame:
    """Typed raw rows to the sample table: merge, ids, calendar; then drop rows without
    a result, so ids keep their gaps."""
    return with_result(merged_samples(typed, season), result)


def merged_samples(
    typed: DataFrame, season: tuple[int, int] | None = SEASON_WEEKS
) -> DataFrame:
    """All merged samples with ids and calendar, also those without a result."""
    numbered = assign_ids(widen(typed)).drop("NUMERIC_ONLY")
    return add_calendar(numbered, season=season)


def with_result(df: DataFrame, result: str = "ENTEROCOCCI") -> DataFrame:
    return df.filter(F.col(result).isNotNull())
