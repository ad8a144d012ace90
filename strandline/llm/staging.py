"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from strandline.session import shared_dir


def staging_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` once and continue from the copy.

    The copy cuts the lineage, is compressed and columnar, and outlives a lost executor.
    """
    path = f"{staging_dir(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staging(spark: SparkSession) -> None:
    """Remove what ``staged`` wrote in this application; call it once results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(staging_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
