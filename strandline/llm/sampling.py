"""The split by document id, and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAIN = 1_000_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def spread_sample(rows: DataFrame, key: Column, want: Column) -> DataFrame:
    """The rows whose key hashes below the share ``want`` (0 to 1): the same in every run."""
    return rows.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(GRAIN)) < want * GRAIN)
