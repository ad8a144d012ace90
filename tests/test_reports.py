from __future__ import annotations

import os
from datetime import datetime, timedelta

import check
import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions.calendar import add_calendar
from strandline.functions.classify import decorate
from strandline.operators.quantiles import value_counts
from strandline.plans import checks
from strandline.plans import distribution as dist
from strandline.plans import exceedance as ex
from strandline.plans import explore as xp
from strandline.plans import persistence as ps
from strandline.plans.stations import (
    attach_station,
    attach_weeks,
    station_choices,
    station_stats_dim,
    week_spine,
)
from strandline.queries import bindings as b
from strandline.queries.registry import REGISTRY
from tests.conftest import as_set, plan_of

T0 = datetime(2014, 6, 2, 9)


def sample(id, days, x, resample=False, other=False, site="S"):
    return (id, site, T0 + timedelta(days=days), float(x), resample, other)


SCHEMA = (
    "id long, SAMPLE_POINT_NAME string, SAMPLE_DATE timestamp_ntz, ENTEROCOCCI double, "
    "RESAMPLE boolean, OTHER boolean"
)


@pytest.fixture(scope="module")
def visits(spark):
    rows = [
        sample(1, 0, 150), sample(2, 1, 120, True), sample(3, 2, 90, True),      # resample of a resample
        sample(4, 7, 200), sample(5, 10, 20, True),                              # gap 3: kept
        sample(6, 14, 105), sample(7, 18, 300, True),                            # gap 4: too late
        sample(8, 21, 104), sample(9, 22, 500, True),                            # 104 is no exceedance
        sample(10, 28, 104.5), sample(11, 28, 80, True),                         # same instant
        sample(12, 365, 130, True),                                              # first of its year
        sample(13, 366, 71), sample(14, 367, 70, other=True),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("YEAR", F.year("SAMPLE_DATE"))
    return decorate(df)


def test_followups(visits):
    previous = ps.with_previous_sample(visits)
    assert as_set(ps.followups(previous), "id") == {(2,), (3,), (5,), (11,)}
    initial = ps.followups(previous, initial_only=True)
    assert as_set(initial, "id") == {(2,), (5,), (11,)}
    total = ps.initial_resample_total(initial).first()
    assert (total.N_TOTAL, total.N_EXCEED) == (3, 1) and total.FRAC == pytest.approx(1 / 3)


def test_support_is_exclusive(visits):
    previous = ps.with_previous_sample(visits)
    near = ps.repeat_exceedance_by_site(previous, min_support=2).first()
    assert (near.N, near.N_GT_104) == (3, 2)
    assert ps.repeat_exceedance_by_site(previous, min_support=3).count() == 0
    initial = ps.followups(previous, initial_only=True)
    assert ps.initial_resample_by_site(initial, min_support=3).count() == 0
    assert ps.initial_resample_by_site(initial, min_support=2).count() == 1


def test_resample_check_looks_across_years(visits):
    # id 12 follows an exceedance-free sample of the year before; id 9 follows 104 exactly
    assert as_set(checks.resample_without_exceedance(visits), "id") == {(9,), (12,)}


def test_one_sample_per_day(visits):
    assert as_set(checks.multiple_per_day(visits), "n") == {(2,)}


def test_class_counts_add_up(visits):
    rows = ex.class_counts_by_site_year(visits.withColumn("SITE_NAME", F.lit("B"))).collect()
    assert rows
    for r in rows:
        assert r.N == r.N_CLEAN + r.N_70 + r.N_104
        assert r.F_CLEAN + r.F_70 + r.F_104 == pytest.approx(1.0)


def test_low_limit_by_site(visits):
    by_year = ex.low_limit_by_site_year(visits)
    for r in by_year.collect():
        assert r.N_BW_70_104 == r.N_GT_70 - r.N_GT_104
    site = ex.low_limit_by_site(by_year).first()
    assert site.MAX_N_RESAMPLE_PER_YEAR == pytest.approx(
        site.MAX_FRAC_BW_70_104 * site.MEAN_N_SAMPLE_PER_YEAR
    )


@pytest.mark.parametrize("values, geomean", [([1, 100], 10.0), ([0, 100], 0.0), ([-1, 0, 5], None)])
def test_geometric_mean_of_zero_and_negative(spark, values, geomean):
    df = spark.createDataFrame([("s", float(v)) for v in values], "SAMPLE_POINT_NAME string, ENTEROCOCCI double")
    got = ex.site_statistics(df).first()
    assert got.GEOMEAN == (None if geomean is None else pytest.approx(geomean))
    assert got.COUNT == len(values)


def test_middle_share_excludes_both_limits(spark):
    df = spark.createDataFrame([("s", v) for v in (70.0, 71.0, 104.0, 105.0)], "SAMPLE_POINT_NAME string, ENTEROCOCCI double")
    got = ex.site_statistics(df).first()
    assert (got.FRAC_GT_SSM, got.FRAC_GT_BAV, got.FRAC_BAV_SSM, got.MEDIAN) == (0.25, 0.75, 0.25, 87.5)


@pytest.fixture(scope="module")
def shares(spark):
    """Group a has no middle class; b and c have equal shares."""
    rows = [("a", "<=70")] * 3 + [("a", ">104")] + [("b", "<=70"), ("b", "70-104")] + [("c", "<=70"), ("c", "70-104")]
    return spark.createDataFrame(rows, "g string, CLASS string")


def test_two_kinds_of_share(shares):
    of_all = dist.class_counts_filled(shares, "g")
    assert sum(r.FRAC for r in of_all.collect()) == pytest.approx(1.0)
    assert as_set(of_all.filter("g = 'a'"), "CLASS", "N", "N_GROUP", "group_rank") == {
        ("<=70", 3, 4, 3), ("70-104", 0, 4, 3), (">104", 1, 4, 3),
    }
    within = dist.class_shares_filled(shares, "g").groupBy("g").agg(F.sum("FRAC").alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in within.collect())


def test_filled_share_and_unfilled_curve(shares):
    one = dist.class_share_of(shares, "g")
    assert as_set(one, "g", "FRAC", "group_rank") == {("a", 0.0, 1), ("b", 0.5, 2), ("c", 0.5, 3)}
    curve = dist.share_cdf(shares, "g")
    middle = curve.filter("CLASS = '70-104'")
    assert as_set(middle, "g", "INDEX") == {("b", 0.5), ("c", 1.0)}
    assert all(r.top == 1.0 for r in curve.groupBy("CLASS").agg(F.max("INDEX").alias("top")).collect())


def test_proportions(spark):
    df = spark.createDataFrame([("<=70", 1.0), (">104", 200.0), (">104", 300.0)], "CLASS string, ENTEROCOCCI double")
    assert as_set(dist.class_proportions(df), "CLASS", "FREQ") == {
        ("<=70", 1 / 3), ("70-104", 0.0), (">104", 2 / 3),
    }
    assert as_set(dist.class_proportions_above(df, 70.0), "CLASS", "FREQ") == {(">104", 1.0)}


def test_histogram_is_right_closed_and_whole(spark):
    df = spark.createDataFrame([(v,) for v in (5.0, 5.01, 15.0, 15.01, 0.0)], "ENTEROCOCCI double")
    got = dist.histogram(df)
    assert as_set(got, "lo", "hi", "n") == {(-5.0, 5.0, 2), (5.0, 15.0, 2), (15.0, 25.0, 1)}
    logs = dist.histogram(df, width=0.3, boundary=0.15, log10=True)
    assert logs.agg(F.sum("n")).first()[0] == 4


def test_capped_histogram(spark):
    df = spark.createDataFrame([("s", ">104", v) for v in (399.0, 400.0, 9000.0)], "SAMPLE_POINT_NAME string, CLASS string, ENTEROCOCCI double")
    assert as_set(dist.capped_histogram(df), "lo", "hi", "n") == {(390.0, 400.0, 3)}


def test_box_statistics(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 100, 100]
    rows = [("s", "LOW", float(v)) for v in values] + [("s", None, 2.0), ("t", "EBB", 8.0)]
    df = spark.createDataFrame(rows, "SAMPLE_POINT_NAME string, TIDE string, ENTEROCOCCI double")
    got = dist.box_stats(df, ["SAMPLE_POINT_NAME", "TIDE"], levels=["LOW", "EBB"])
    assert as_set(got, "SAMPLE_POINT_NAME", "TIDE", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n") == {
        ("s", "LOW", 3.0, 5.0, 7.0, 1.0, 7.0, 9), ("s", None, 2.0, 2.0, 2.0, 2.0, 2.0, 1),
        ("s", "EBB", None, None, None, None, None, 0), ("t", "EBB", 8.0, 8.0, 8.0, 8.0, 8.0, 1),
        ("t", "LOW", None, None, None, None, None, 0),
    }
    outliers = dist.box_outliers(df, ["SAMPLE_POINT_NAME", "TIDE"])
    assert as_set(outliers, "TIDE", "ENTEROCOCCI", "n") == {("LOW", 100.0, 2)}


def test_rank_curve_counts_zero_shares(spark):
    means = spark.createDataFrame(
        [("a", "N_70", 0.0), ("b", "N_70", 0.5), ("a", "N_CLEAN", 1.0)],
        "SAMPLE_POINT_NAME string, VAR string, MEAN_FRAC double",
    )
    got = dist.rank_curve(means, drop=["N_CLEAN"])
    assert as_set(got, "SAMPLE_POINT_NAME", "RANK", "FREQ", "COMPLEMENT") == {("a", 1, 0.5, 0.5), ("b", 2, 1.0, 0.0)}


def test_calendar_grid_has_every_cell(visits):
    cells = xp.calendar_cells(add_calendar(visits))
    full = xp.calendar_full(cells)
    assert full.select("SAMPLE_POINT_NAME", "YEAR", "WEEK", "WEEKDAY").distinct().count() == 2 * 27 * 7
    assert full.filter("CLASS IS NOT NULL").count() == cells.count()
    # A sample out of season, whose week is unknown, stays a cell of the full calendar.
    undated = cells.unionByName(cells.limit(1).withColumn("WEEK", F.lit(None).cast("int")))
    assert undated.exceptAll(xp.calendar_full(undated).select(undated.columns)).count() == 0
    assert xp.calendar_full(undated).count() == full.count() + 1
    early = xp.calendar_cells(add_calendar(visits), classes="two", max_week=23, resamples=False)
    assert as_set(early, "WEEK", "CLASS") == {(23, ">104"), (23, "<104")}


def test_explore_needs_a_type(visits):
    with pytest.raises(ValueError):
        xp.explore(visits, [])
    assert xp.explore(visits, ["Irregular"], "S").count() == 1
    assert xp.explore(visits, ["Routine"], "elsewhere").count() == 0


def test_types_with_zero_are_shown(visits):
    assert ("Special", 0) in as_set(
        ex.type_frequency(visits, ("Routine", "Special")), "SAMPLE_TYPE", "n"
    )


def test_stations_fan_out_and_keep_nulls(spark, visits):
    stations = spark.createDataFrame(
        [("S", "T", "B1"), ("S", "T", "B2"), ("Z", None, "B3")],
        "SAMPLE_POINT_NAME string, TOWN string, SITE_NAME string",
    )
    assert attach_station(visits, stations).count() == 2 * visits.count()
    joined = station_stats_dim(stations, ex.site_statistics(visits))
    assert joined.filter("SAMPLE_POINT_NAME = 'Z' AND COUNT IS NULL").count() == 1
    assert as_set(station_choices(stations), "LABEL") >= {("NA - B3 - Z",)}


def test_week_spine(spark):
    years = spark.createDataFrame([(2016,), (2016,)], "YEAR int")
    spine = week_spine(years)
    assert spine.count() == 14
    first = spine.orderBy("WEEK").first()
    assert (first.WEEK, first.START_LABEL, first.label_rank) == (23, "May 29", 1)
    rows = spark.createDataFrame([(2016, 23), (2016, 1)], "YEAR int, WEEK int")
    assert as_set(attach_weeks(rows, spine), "WEEK", "START_LABEL") == {(23, "May 29"), (1, None)}


def test_map_metric_range_is_over_sites(spark):
    stats = spark.createDataFrame([("a", 0.1), ("b", 0.4)], "SAMPLE_POINT_NAME string, FRAC_GT_SSM double")
    stations = stats.withColumns({"LATITUDE": F.lit(1.0), "LONGITUDE": F.lit(2.0)}).filter("FRAC_GT_SSM < 0.2")
    row = xp.map_metric(stations, stats, "FRAC_GT_SSM").first()
    assert (row.value, row.domain_lo, row.domain_hi) == pytest.approx((10.0, 10.0, 40.0))
    with pytest.raises(ValueError):
        xp.map_metric(stations, stats, "MODE")


# --- plans ---------------------------------------------------------------------------


def tree(df) -> str:
    return plan_of(df).split("\n\n\n")[0]


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = plan_of(ex.low_limit_by_site_year(b.event_samples(spark, small)))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    assert "PushedFilters: [Not(EqualTo(event_type,error))" in plan or "Not(EqualTo(event_type,signup))" in plan
    # What site statistics write in order first.
    stats = plan_of(value_counts(b.event_samples(spark, small), ["SAMPLE_POINT_NAME"], "ENTEROCOCCI"))
    assert "PushedFilters: [IsNotNull(value)]" in stats


def test_site_year_table_shuffles_once(spark, small):
    plan = tree(ex.class_counts_by_site_year(b.order_samples(spark, small), limits=b.ORDER_LIMITS))
    assert plan.count("+- Exchange") == 1


def test_no_window_over_a_single_partition(spark, small):
    events = b.decorated_events(spark, small)
    jobs = [
        ps.with_previous_sample(events),
        ex.site_statistics(events),
        dist.box_stats(events, ["SAMPLE_POINT_NAME"]),
        dist.share_cdf(events, "SAMPLE_POINT_NAME"),
        dist.class_counts_filled(events, "SAMPLE_POINT_NAME"),
    ]
    checked = 0
    for job in jobs:
        lines = plan_of(job, "simple").splitlines()
        for i, line in enumerate(lines):
            # Offsets of range chunks are one row per shuffle partition, so exempt.
            if "Window [" in line and "__chunk" not in line:
                source = next((x for x in lines[i + 1 :] if "Exchange" in x or "Scan" in x), "")
                checked += 1
                assert "SinglePartition" not in source
    assert checked >= 3


def test_null_class_as_in_sql(spark, tmp_path):
    """A sample without a value has no class; the queries and their SQL agree on it."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    known = (F.col("event_id") % 7 != 0) & (F.col("event_id") % 11 != 0)
    value = F.when(known, F.col("value")).when(F.col("event_id") % 7 != 0, float("nan"))
    sf = str(tmp_path)
    events.withColumn("value", value).write.parquet(f"{sf}/events.parquet")
    for name in ("region", "nation", "customer", "supplier", "orders", "lineitem"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "orders":
            price = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
            df = df.withColumn("o_totalprice", price)
        df.write.parquet(f"{sf}/{name}.parquet")
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}/*.parquet')")
    names = ["c2_three_classes", "w6_share_of_group", "w7_group_total", "a16_class_proportions",
             "a17_conditional_proportions", "a18_class_counts_by_beach", "a19_class_shares_by_site",
             "a20_share_between_limits_by_site", "w8_share_cdf_by_site"]
    for name in names:
        assert check.compare(spark, con, name, sf).startswith("ok"), name
    null = REGISTRY["w6_share_of_group"].job(spark, sf).where("CLASS IS NULL").count()
    assert null > 0


def test_full_calendar_reads_its_input_once(spark, small):
    cells = xp.calendar_cells(b.calendar_orders(spark, small), limits=b.ORDER_LIMITS)
    assert "orders.parquet" not in plan_of(xp.calendar_full(cells))
