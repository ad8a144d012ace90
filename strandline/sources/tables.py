"""Scans and sinks with declared schemas."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.model import RAW_COLUMNS, RAW_DATE_COLUMN, RAW_DROPPED

FLAG_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("stn", T.StringType())]
)


def raw_schema(
    columns: Sequence[str] = RAW_COLUMNS, date_column: str = RAW_DATE_COLUMN
) -> T.StructType:
    """Every raw column is text but the sample date."""
    return T.StructType(
        [
            T.StructField(c, T.TimestampNTZType() if c == date_column else T.StringType())
            for c in columns
        ]
    )


def read_raw(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    columns: Sequence[str] | None = None,
    date_column: str = RAW_DATE_COLUMN,
    timestamp_format: str | None = None,
) -> DataFrame:
    """Raw measurement rows, one per parameter, without type inference.

    Columns are those of the header unless given; a needed one that is missing is an error.
    """
    if fmt == "csv" and columns is None:
        columns = spark.read.option("header", True).csv(path).columns
    elif columns is None:
        columns = spark.read.format(fmt).load(path).columns
    missing = [c for c in RAW_COLUMNS if c not in columns and c not in RAW_DROPPED]
    if missing:
        raise ValueError(f"raw table lacks {missing}")
    if fmt != "csv":
        return spark.read.schema(raw_schema(columns, date_column)).format(fmt).load(path)
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    # Blanks are data here: cleaning removes them later. A header that differs from the
    # schema must fail, not shift the columns.
    rows = spark.read.schema(text).options(
        header=True,
        enforceSchema=False,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return rows.withColumn(date_column, _read_date(F.col(f"`{date_column}`"), timestamp_format))


def _read_date(text: Column, timestamp_format: str | None) -> Column:
    """The date a text holds, NULL for a blank one; any other text is an error."""
    blank = F.trim(text) == ""
    if timestamp_format is None:
        read = F.to_timestamp_ntz(F.when(~blank, text))
    else:
        read = F.to_timestamp_ntz(F.when(~blank, text), F.lit(timestamp_format))
    message = F.concat(F.lit("unreadable date: "), text)
    return F.when(read.isNull() & ~blank, F.raise_error(message)).otherwise(read)


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """A flag list: sample id and sample point name, by the header's names, in any order.

    A list without these columns, and an id that is no number, are errors.
    """
    rows = spark.read.option("header", True).csv(path)
    missing = [f.name for f in FLAG_SCHEMA if f.name not in rows.columns]
    if missing:
        raise ValueError(f"flag list lacks {missing}")
    number = F.expr("try_cast(trim(id) AS bigint)")
    bad = F.concat(F.lit("flag id is no number: "), F.coalesce("id", F.lit("NULL")))
    return rows.select(F.when(number.isNull(), F.raise_error(bad)).otherwise(number).alias("id"), "stn")


def write_csv(
    df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none"
) -> None:
    """CSV with a header; text keeps its own blanks.

    A compressed file is read in one task, so its rows should come from a bounded partition.
    """
    df.write.mode(mode).options(
        header=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        compression=compression,
    ).csv(path)


def write_stage(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    check: Callable[[DataFrame], None] | None = None,
) -> None:
    """A stage hand-over table in place of an earlier one; flagged samples go by YEAR.

    Rows are spread over (partition columns, and within them evenly) before the write,
    so that a heavy year does not become one task and a task does not open every year.

    The rows are written to a fresh folder, which ``check`` may read, and only then take the
    place of the old stage. If the write or the check fails the old stage stays as it was.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    spark, path = df.sparkSession, path.rstrip("/")
    fresh = f"{path}.new-{uuid4().hex}"
    try:
        df.write.partitionBy(*partition_by).parquet(fresh)
        if check is not None:
            check(read_stage(spark, fresh))
        _publish(spark, fresh, path)
    finally:
        _folder(spark, fresh)[0].delete(_folder(spark, fresh)[1], True)


def _folder(spark: SparkSession, path: str) -> tuple:
    """The file system of a folder, and the folder as it knows it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _publish(spark: SparkSession, fresh: str, path: str) -> None:
    fs, there = _folder(spark, path)
    aside = _folder(spark, f"{path}.old-{uuid4().hex}")[1]
    had = fs.exists(there)
    if had and not fs.rename(there, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(_folder(spark, fresh)[1], there):
        if had:
            fs.rename(aside, there)
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(aside, True)


def read_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
