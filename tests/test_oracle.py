"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check
from strandline.queries.registry import REGISTRY
from tests.conftest import SMALL


# At this size no site has the support these ask for, and no point has two station rows.
MAY_BE_EMPTY = {
    "a21_repeat_exceedance_by_site", "a23_initial_resample_by_site", "q1_ambiguous_stations",
}


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    outcome = check.compare(spark, con, name, SMALL)
    good = ("ok", "EMPTY") if name in MAY_BE_EMPTY else ("ok",)
    assert outcome.startswith(good), outcome


def test_every_query_has_an_oracle():
    assert set(REGISTRY) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
