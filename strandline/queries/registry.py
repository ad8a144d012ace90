"""Name -> (DataFrame function, SQL statement)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    job: Job
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, job, sql)
        return job

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and print dates, so that engines' last bits and types do not matter."""

    def shown(name: str, kind: str) -> Column:
        col = F.col(f"`{name}`")
        if kind == "double":
            return F.round(col, digits).alias(name)
        return col.cast("string").alias(name) if kind == "date" else col

    return df.select(*[shown(name, kind) for name, kind in df.dtypes])
