"""Rows in a total order, written once and read back chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import shared_dir

CHUNK, POSITION = "__chunk", "__pos"
#: Where monotonically_increasing_id counts within a partition.
PLACE = (1 << 33) - 1


_scopes: list[str] = []


def handover_dir(spark: SparkSession) -> str:
    base = f"{shared_dir(spark).rstrip('/')}/handover-{spark.sparkContext.applicationId}"
    return "/".join([base, *_scopes])


def in_order(df: DataFrame, sort: Sequence[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted on ``sort``, with ``__chunk``, the range chunk, and
    ``__pos``, which grows with the order and whose low 33 bits are the place in the chunk.

    The rows are shuffled once and written once, compressed and by column, to the shared folder:
    a second evaluation could choose other range bounds. The copy is bucketed by chunk, so that
    windows and aggregates by chunk read it in place. It outlives lost executors.
    """
    spark = df.sparkSession
    placed = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumns({CHUNK: F.spark_partition_id(), POSITION: F.monotonically_increasing_id()})
    )
    key = uuid4().hex
    # More buckets than chunks, as buckets go by a hash and two chunks may share one.
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"handover_{key}"
    placed.write.bucketBy(buckets, CHUNK).option("path", f"{handover_dir(spark)}/{key}").saveAsTable(
        name
    )
    copy = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry in the catalog; the files stay for ``copy``
    return copy


def written_once(df: DataFrame) -> DataFrame:
    """``df`` as a compressed, columnar copy in the shared folder, for plans that read it twice."""
    path = f"{handover_dir(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def handovers(spark: SparkSession) -> Iterator[None]:
    """What is handed over within is removed at the end, when all results are written."""
    _scopes.append(uuid4().hex)
    try:
        yield
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(handover_dir(spark))
        _scopes.pop()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
