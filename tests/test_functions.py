from __future__ import annotations

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.functions import classify as c
from strandline.functions.calendar import add_calendar, calweek, weekday_index
from strandline.functions.geo import utm_to_latlon
from strandline.functions.text import to_integer, to_number, trimmed

NAN = float("nan")
VALUES = [-1.0, 0.0, 10.0, 70.0, 70.5, 104.0, 104.5, NAN, None]


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, ENTEROCOCCI double")


def column_of(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_flags_at_the_limits(limits):
    rows = c.add_flags(limits).orderBy("i").select("GT_104", "GT_70", "BW_70_104").collect()
    assert [tuple(r) for r in rows] == [
        (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 1, 1), (0, 1, 1), (1, 1, 0),
        (None, None, None), (None, None, None),
    ]


def test_nested_classes_put_zero_in_the_lowest(limits):
    assert column_of(limits, c.class_of("ENTEROCOCCI")) == [
        "<70", "<70", "<70", "<70", "70-104", "70-104", ">104", None, None,
    ]


def test_interval_classes_leave_zero_out(limits):
    assert column_of(limits, c.binned_class_of("ENTEROCOCCI")) == [
        None, None, "<70", "<70", "70-104", "70-104", ">104", None, None,
    ]


def test_two_classes_and_class_by_sum(limits):
    assert column_of(limits, c.two_class_of("ENTEROCOCCI"))[4:7] == ["<104", "<104", ">104"]
    flagged = c.add_flags(limits)
    assert column_of(flagged, c.class_by_sum())[3:] == [
        "<=70", "70-104", "70-104", ">104", None, None,
    ]


def test_cap_keeps_null(limits):
    assert column_of(limits, c.cap("ENTEROCOCCI", 70.0))[4:7] == [70.0, 70.0, 70.0]
    assert column_of(limits, c.cap("ENTEROCOCCI", 70.0))[8] is None


def test_resample_wins_over_other(spark):
    df = spark.createDataFrame(
        [(0, True, True), (1, False, True), (2, False, False)], "i int, RESAMPLE boolean, OTHER boolean"
    )
    assert column_of(df, c.sample_type()) == ["Resample", "Irregular", "Routine"]


def test_ordered_category(spark):
    df = spark.createDataFrame([(0, "LOW"), (1, "EBB"), (2, "SLACK"), (3, None)], "i int, TIDE string")
    out = c.as_ordered(df, "TIDE", ("LOW", "EBB")).orderBy("i").select("TIDE", "TIDE_LEVEL").collect()
    assert [tuple(r) for r in out] == [("LOW", 1), ("EBB", 2), (None, None), (None, None)]


def test_harmonise_prefers_24_hours(spark):
    df = spark.createDataFrame(
        [(0, None, 1.0, None, "A"), (1, 2.0, 9.0, "B", "A"), (2, None, None, None, None)],
        "i int, ACCUMULATION_24HR double, ACCUMULATION_48HR double, "
        "PAST_WEATHER_24HR string, PAST_WEATHER_48HR string",
    )
    out = c.harmonise(df).orderBy("i").select("ACCUMULATION", "PAST_WEATHER").collect()
    assert [tuple(r) for r in out] == [(1.0, "A"), (4.0, "B"), (None, None)]


def test_override_ignores_unknown(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", None), (2, "b", 1)], "i int, s string, y int").withColumn(
        "flag", F.lit(False)
    )
    out = c.override(df, [{"s": "a", "y": 1}], "flag", True)
    assert column_of(out, "flag") == [True, False, False]


def test_tolerant_casts(spark):
    df = spark.createDataFrame(
        [(0, "1.0"), (1, " 12.9 "), (2, "<10"), (3, ""), (4, None), (5, "12d"), (6, "NaN"), (7, "1e3"),
         (8, "12f\t"), (9, "5.\t")],
        "i int, x string",
    )
    assert column_of(df, to_number("x")) == [1.0, 12.9, None, None, None, None, None, 1000.0, None, 5.0]
    assert column_of(df, to_integer("x")) == [1, 12, None, None, None, None, None, 1000, None, 5]


def test_trim_takes_all_whitespace(spark):
    df = spark.createDataFrame([(0, "\t a b \n"), (1, "\u00a0x\u2003"), (2, ""), (3, None)], "i int, x string")
    assert column_of(df, trimmed("x")) == ["a b", "x", "", None]


def python_calweek(day: date) -> int:
    offset = (date(day.year, 1, 1).weekday() + 1) % 7
    moved = day + timedelta(days=offset)
    week = (moved.timetuple().tm_yday - 1) // 7 + 1
    return week + 52 if week == 1 and day.month == 12 else week


def test_calweek_every_day(spark):
    first, n = date(2000, 1, 1), 365 * 33 + 9
    days = spark.range(n).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("d"))
    got = {r.d: r.w for r in days.select("d", calweek("d").alias("w")).collect()}
    assert got == {d: python_calweek(d) for d in got}
    assert got[date(2016, 1, 1)] == 1


def test_calweek_constant_from_sunday_to_saturday(spark):
    days = spark.range(366 * 12).select(F.date_add(F.lit(date(2004, 1, 1)), F.col("id").cast("int")).alias("d"))
    weeks = days.withColumns(
        {"w": calweek("d"), "y": F.year("d"), "sunday": F.date_sub("d", F.dayofweek("d") - 1)}
    ).filter(F.year("sunday") == F.col("y"))
    mixed = weeks.groupBy("y", "sunday").agg(F.countDistinct("w").alias("n")).filter("n > 1")
    assert mixed.count() == 0


def test_calendar_season_and_weekday(spark):
    df = spark.sql("SELECT timestamp_ntz'2015-07-05 10:00:00' AS SAMPLE_DATE, 0 AS i UNION ALL "
                   "SELECT timestamp_ntz'2015-01-03 10:00:00', 1")
    rows = add_calendar(df).withColumn("k", weekday_index("WEEKDAY")).orderBy("i").collect()
    assert (rows[0].WEEKDAY, rows[0].WEEK, rows[0].k) == ("Sun", 28, 1)
    assert (rows[1].WEEKDAY, rows[1].WEEK) == ("Sat", None)


def forward(lat: float, lon: float, zone: int) -> tuple[float, float]:
    """Textbook forward UTM by power series, to test the inverse independently."""
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    p = math.radians(lat)
    n = a / math.sqrt(1 - e2 * math.sin(p) ** 2)
    t, c_ = math.tan(p) ** 2, ep2 * math.cos(p) ** 2
    aa = math.cos(p) * math.radians(lon - (zone * 6 - 183))
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p)
        - (35 * e2**3 / 3072) * math.sin(6 * p)
    )
    x = k0 * n * (
        aa + (1 - t + c_) * aa**3 / 6 + (5 - 18 * t + t * t + 72 * c_ - 58 * ep2) * aa**5 / 120
    ) + 500000
    y = k0 * (
        m
        + n * math.tan(p) * (
            aa**2 / 2
            + (5 - t + 9 * c_ + 4 * c_ * c_) * aa**4 / 24
            + (61 - 58 * t + t * t + 600 * c_ - 330 * ep2) * aa**6 / 720
        )
    )
    return x, y


def test_inverse_projection_undoes_forward(spark):
    points = [(lat, lon) for lat in (41.0, 43.5, 45.2) for lon in (-71.9, -69.0, -66.1)]
    rows = [(*forward(lat, lon, 19), lat, lon) for lat, lon in points]
    df = spark.createDataFrame(rows, "e double, n double, lat double, lon double")
    lat, lon = utm_to_latlon("e", "n", 19)
    for row in df.select(lat.alias("a"), lon.alias("b"), "lat", "lon").collect():
        assert row.a == pytest.approx(row.lat, abs=1e-7)
        assert row.b == pytest.approx(row.lon, abs=1e-7)
