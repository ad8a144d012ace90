from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.operators.groups import with_group_count, with_group_share, with_group_total
from strandline.operators.joins import null_safe_join
from strandline.operators.previous import with_previous
from strandline.operators import quantiles
from strandline.operators.quantiles import group_quantiles
from strandline.operators.ranking import rank_by, rank_levels, row_numbers
from strandline.operators.reshape import (
    pivot_fill,
    pivot_strict,
    record_as_rows,
    row_fingerprint,
    stack,
    unlisted,
    unpivot,
)
from tests.conftest import as_set, plan_of


# --- row numbers ------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, a NULL group, many ties."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "c"])
        rows.append((i, group, float(rng.randint(0, 5))))
    return spark.createDataFrame(rows, "id long, g string, x double")


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_row_numbers_equal_a_window_for_any_partitioning(spark, skewed, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        order = [F.col("x").asc(), F.col("id").asc()]
        got = row_numbers(skewed.repartition(partitions), order, ["g"], "rn", "size")
        by = W.partitionBy("g")
        want = skewed.withColumns(
            {"rn": F.row_number().over(by.orderBy("x", "id")).cast("long"), "size": F.count("*").over(by)}
        )
        assert as_set(got, "id", "g", "rn", "size") == as_set(want, "id", "g", "rn", "size")
        whole = row_numbers(skewed, order, name="rn")
        want_all = skewed.withColumn("rn", F.row_number().over(W.orderBy("x", "id")).cast("long"))
        assert as_set(whole, "id", "rn") == as_set(want_all, "id", "rn")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_row_numbers_of_nothing(spark, skewed):
    assert row_numbers(skewed.filter("id < 0"), [F.col("id")]).count() == 0


def test_rank_levels_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5), ("d", None)], "s string, m double")
    assert as_set(rank_levels(df, "s", "m"), "s", "level_rank") == {("c", 1), ("a", 2), ("b", 3), ("d", 4)}
    assert as_set(rank_levels(df, "s", "m", desc=True), "s", "level_rank") == {
        ("a", 1), ("b", 2), ("c", 3), ("d", 4),
    }
    assert [r.s for r in rank_by(df, "m", ["s"], k=2).collect()] == ["a", "b"]


# --- quantiles ------------------------------------------------------------------------


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {
        "hot": rng.lognormal(3, 2, 3000),
        "signed": np.concatenate([rng.normal(0, 5, 501), np.zeros(40), [-1e12, 1e12, 1e-300, -1e-300]]),
        "ties": rng.integers(-3, 3, 400).astype(float),
        "one": np.array([4.25]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    rows += [("hot", None), ("empty", None), ("one", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    names = [f"p{i}" for i in range(len(probs))]
    got = {r.g: r for r in group_quantiles(df, ["g"], "x", probs, names).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g].n == len(values)
        for name, p in zip(names, probs, strict=True):
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300)


def test_quantiles_of_values_that_share_a_bucket(spark):
    # Distinct seconds of a day and a bit: all lie in one slice of an octave.
    df = spark.range(100_000).select(F.lit("g").alias("g"), (F.col("id") * 0.5 + 1.7e9).alias("x"))
    got = group_quantiles(df, ["g"], "x", [0.1, 0.5, 0.99], ["a", "b", "c"]).first()
    values = np.arange(100_000) * 0.5 + 1.7e9
    assert [got.a, got.b, got.c] == pytest.approx(np.quantile(values, [0.1, 0.5, 0.99]), rel=1e-12)


def test_ranks_over_chunks(spark):
    """A group over many range chunks, groups within one, and NULL: ranks cover 0 .. n - 1."""
    hot = spark.range(900).select(F.lit("m").alias("g"), (F.col("id") % 300).cast("double").alias("x"))
    few = spark.createDataFrame(
        [(g, float(k)) for g in ("a", "z", None) for k in range(7)], "g string, x double"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        counts = quantiles.value_counts(hot.unionByName(few), ["g"], "x")
        ranked = quantiles.ranked_counts(counts, ["g"], "x")
        rows = ranked.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, n in (("m", 900), ("a", 7), ("z", 7), (None, 7)):
        own = sorted((r["__start"], r.w, r.x) for r in rows if r.g == g)
        assert {r["__total"] for r in rows if r.g == g} == {n}
        assert [s for s, _, _ in own] == [sum(w for _, w, _ in own[:k]) for k in range(len(own))]
        assert [x for _, _, x in own] == sorted(x for _, _, x in own)
    plan = plan_of(ranked, "simple").split("== Initial Plan ==")[-1]
    assert "rangepartitioning(g" not in plan  # the ordered copy is read in place
    assert plan.count("Exchange hashpartitioning") <= 1  # of two rows a chunk


def test_quantiles_of_null_group_and_of_all(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    got = {r.g: r.m for r in group_quantiles(df, ["g"], "x", [0.5], ["m"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


# --- previous row ------------------------------------------------------------------------


def test_previous_rows_are_shuffled_once(spark, visits):
    plan = plan_of(with_previous(visits, ["s"], ["x"], "ts", "id"), "simple")
    assert "Exchange rangepartitioning" not in plan  # done before the copy was written
    assert "Exchange hashpartitioning" not in plan


@pytest.fixture(scope="module")
def visits(spark):
    rng = random.Random(11)
    start = datetime(2014, 12, 20, 23, 50)
    rows = []
    for i in range(2000):
        site = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        # few distinct instants, so that ties are common
        ts = start + timedelta(minutes=rng.choice([0, 1, 5, 600, 1500, 4000, 50000]) * rng.randint(0, 9))
        rows.append((i, site, None if i % 97 == 0 else ts, float(rng.randint(0, 200)), i % 5 == 0))
    df = spark.createDataFrame(rows, "id long, s string, ts timestamp_ntz, x double, r boolean")
    return df.withColumn("y", F.year("ts"))


@pytest.fixture(params=[1, 3, 8])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _plain_previous(df, partition):
    w = W.partitionBy(*partition).orderBy(F.col("ts").asc_nulls_last(), F.col("id").asc_nulls_last())
    return df.withColumns(
        {
            "PREV_x": F.lag("x").over(w),
            "PREV_r": F.lag("r").over(w),
            "DIFFTIME": F.date_diff(F.to_date("ts"), F.to_date(F.lag("ts").over(w))),
        }
    )


@pytest.mark.parametrize("partition", [["s"], ["s", "y"]])
def test_previous_equals_a_plain_window(visits, partitions, partition):
    got = with_previous(visits, partition, ["x", "r"], "ts", "id")
    cols = ["id", "s", "ts", "x", "r", "PREV_x", "PREV_r", "DIFFTIME"]
    assert got.columns == [*visits.columns, "PREV_x", "PREV_r", "DIFFTIME"]
    assert got.count() == visits.count()
    assert as_set(got, *cols) == as_set(_plain_previous(visits, partition), *cols)


@pytest.mark.parametrize("kind", ["text id", "NULL id", "one instant"])
def test_previous_with_odd_ids_and_a_hot_instant(visits, partitions, kind):
    if kind == "text id":
        df = visits.withColumn("id", F.concat(F.lit("k"), F.col("id")))
    elif kind == "NULL id":
        # One NULL id per site and instant at most, so that the order is total.
        first = W.partitionBy("s", "ts").orderBy("id")
        df = visits.withColumn("id", F.when(F.row_number().over(first) > 1, F.col("id")))
    else:
        df = visits.withColumn("ts", F.lit("2015-06-01 10:00:00").cast("timestamp_ntz"))
    cols = ["id", "s", "ts", "x", "r", "PREV_x", "PREV_r", "DIFFTIME"]
    got = with_previous(df, ["s"], ["x", "r"], "ts", "id")
    assert sorted(map(repr, got.select(*cols).collect())) == sorted(
        map(repr, _plain_previous(df, ["s"]).select(*cols).collect())
    )


def test_gap_counts_calendar_days(spark):
    df = spark.sql(
        "SELECT 1 AS id, 's' AS s, timestamp_ntz'2015-06-01 23:59:00' AS ts, 1.0 AS x UNION ALL "
        "SELECT 2, 's', timestamp_ntz'2015-06-02 00:01:00', 2.0"
    )
    rows = with_previous(df, ["s"], ["x"], "ts", "id").orderBy("id").collect()
    assert [r.DIFFTIME for r in rows] == [None, 1]


# --- reshape ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(
        [("k1", "A", 1.0), ("k1", "B", None), ("k2", "A", 3.0), (None, "B", 4.0), ("k3", "Z", 9.0)],
        "k string, name string, v double",
    )


def test_strict_pivot_and_back(cells):
    wide = pivot_strict(cells, ["k"], "name", "v", ["A", "B"])
    assert as_set(wide, "k", "A", "B") == {
        ("k1", 1.0, None), ("k2", 3.0, None), (None, None, 4.0), ("k3", None, None),
    }
    back = unpivot(wide, ["k"], ["A", "B"], drop_null=True, name="name", value="v")
    assert as_set(back, "k", "name", "v") == {("k1", "A", 1.0), ("k2", "A", 3.0), (None, "B", 4.0)}
    assert unpivot(wide, ["k"], ["A", "B"]).count() == 8
    assert as_set(unlisted(cells, "name", ["A", "B"]), "k") == {("k3",)}


def test_strict_pivot_fails_on_a_second_row(cells):
    twice = stack(cells, cells.filter("name = 'B' AND k = 'k1'"))
    with pytest.raises(PySparkException, match="more than one value"):
        pivot_strict(twice, ["k"], "name", "v", ["A", "B"]).collect()


def test_pivot_fill(cells):
    wide = pivot_fill(cells, ["k"], "name", "v", ["A", "B"], fill=0.0)
    assert as_set(wide, "k", "A", "B") == {("k1", 1.0, 0.0), ("k2", 3.0, 0.0), (None, 0.0, 4.0), ("k3", 0.0, 0.0)}


def test_fingerprint_sees_where_nulls_are(spark):
    df = spark.createDataFrame([("1", None), (None, "1"), ("1", None)], "a string, b string")
    assert df.select(row_fingerprint(df.columns).alias("h")).distinct().count() == 2


def test_record_as_rows(spark):
    df = spark.createDataFrame([("p", 3, 1.5)], "SAMPLE_POINT_NAME string, n int, x double")
    got = record_as_rows(df, {"SAMPLE_POINT_NAME": "Station ID", "n": "# (n.)", "x": "X"})
    assert as_set(got, "SAMPLE_POINT_NAME", "FIELD", "VALUE") == {
        ("p", "Station ID", "p"), ("p", "# (n.)", "3"), ("p", "X", "1.5"),
    }


# --- joins and groups -----------------------------------------------------------------------------


def test_null_keys_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, l int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("c", 30)], "k string, r int")
    assert as_set(null_safe_join(left, right, ["k"], "full_outer"), "k", "l", "r") == {
        (None, 1, 10), ("a", 2, 20), ("b", 3, None), ("c", None, 30),
    }
    assert as_set(null_safe_join(left, right, ["k"], "left_anti"), "k", "l") == {("b", 3)}


def test_group_values_on_rows(skewed):
    by = W.partitionBy("g")
    assert as_set(with_group_count(skewed, ["g"]), "id", "n") == as_set(
        skewed.withColumn("n", F.count("*").over(by)), "id", "n"
    )
    assert as_set(with_group_total(skewed, ["g"], "x"), "id", "N_GROUP") == as_set(
        skewed.withColumn("N_GROUP", F.sum("x").over(by)), "id", "N_GROUP"
    )
    shares = with_group_share(skewed, ["g"], "x").groupBy("g").agg(F.sum("FRAC").alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in shares.collect())
