from __future__ import annotations

import pytest


@pytest.fixture
def rows(spark):
    """Build a DataFrame from a DDL schema and tuples, split over a few partitions."""

    def build(schema, data, parts=3):
        return spark.createDataFrame(data, schema).repartition(parts)

    return build
