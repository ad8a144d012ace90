"""C, G, Q, J2-J4, D4, X: classes, flags, checks, dimensions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandline.functions import geo
from strandline.functions.calendar import calweek
from strandline.functions.classify import (
    add_flags,
    add_sample_type,
    as_ordered,
    binned_class_of,
    cap,
    class_by_sum,
    class_of,
    harmonise,
    override,
    two_class_of,
)
from strandline.model import CURRENT_WEATHER_LEVELS, TIDE_LEVELS
from strandline.operators.joins import members, non_members
from strandline.operators.ranking import rank_levels
from strandline.plans import checks, stations
from strandline.plans.assembly import extract_categories, extract_numeric
from strandline.plans.exceedance import site_statistics
from strandline.plans.flags import assign_flags, fold_ledger
from strandline.queries import bindings as b
from strandline.queries.registry import query, rounded

E, O = b.EVENTS_SQL, b.ORDERS_SQL


# --- classes ---------------------------------------------------------------------------


@query(
    "c1_exceedance_flags",
    f"WITH {E} SELECT id, GT_104, GT_70, CAST(GT_70 * (1 - GT_104) AS INTEGER) AS BW_70_104 FROM e",
)
def _(spark, sf):
    flagged = add_flags(b.event_samples(spark, sf))
    return flagged.select("id", "GT_104", "GT_70", "BW_70_104")


@query(
    "c2_three_classes",
    f"WITH {E} SELECT id, {b.class_sql(70, 104, '<70')} AS COLOR FROM e",
)
def _(spark, sf):
    return b.event_samples(spark, sf).select("id", class_of("ENTEROCOCCI").alias("COLOR"))


@query(
    "c3_interval_classes",
    """SELECT event_id AS id, CASE WHEN value - 20 > 104 THEN '>104' WHEN value - 20 > 70 THEN '70-104'
  WHEN value - 20 > 0 THEN '<70' END AS EXCEED_GRP FROM events""",
)
def _(spark, sf):
    # Shifted so that some values are not positive and so have no interval.
    shifted = F.col("ENTEROCOCCI") - 20
    return b.event_samples(spark, sf).select("id", binned_class_of(shifted).alias("EXCEED_GRP"))


@query("c4_class_by_flag_sum", f"WITH {E} SELECT id, CLASS FROM e")
def _(spark, sf):
    flagged = add_flags(b.event_samples(spark, sf))
    return flagged.select("id", class_by_sum().alias("CLASS"))


@query(
    "c5_two_classes",
    f"WITH {E} SELECT id, CASE WHEN ENTEROCOCCI > 104 THEN '>104' ELSE '<104' END AS COLOR FROM e",
)
def _(spark, sf):
    return b.event_samples(spark, sf).select("id", two_class_of("ENTEROCOCCI").alias("COLOR"))


@query("c6_sample_type", f"WITH {O} SELECT id, SAMPLE_TYPE FROM o")
def _(spark, sf):
    return add_sample_type(b.order_samples(spark, sf)).select("id", "SAMPLE_TYPE")


_TIDES = ", ".join(f"'{t}'" for t in TIDE_LEVELS)
_WEATHERS = ", ".join(f"'{t}'" for t in CURRENT_WEATHER_LEVELS)


@query(
    "c7_ordered_category",
    f"""WITH {b.WIDE_SQL} SELECT {b.KEYS_SQL}, CASE WHEN TIDE IN ({_TIDES}) THEN TIDE END AS TIDE,
  CAST(nullif(list_position([{_TIDES}], TIDE), 0) AS INTEGER) AS TIDE_LEVEL,
  CASE WHEN CURRENT_WEATHER IN ({_WEATHERS}) THEN CURRENT_WEATHER END AS CURRENT_WEATHER,
  CAST(nullif(list_position([{_WEATHERS}], CURRENT_WEATHER), 0) AS INTEGER) AS CURRENT_WEATHER_LEVEL FROM w""",
)
def _(spark, sf):
    wide = b.wide_samples(spark, sf)
    ordered = as_ordered(
        as_ordered(wide, "TIDE", TIDE_LEVELS), "CURRENT_WEATHER", CURRENT_WEATHER_LEVELS
    )
    return ordered.select(
        "SAMPLE_POINT_NAME", "DEP_SAMPLE_ID", "SAMPLE_DATE",
        "TIDE", "TIDE_LEVEL", "CURRENT_WEATHER", "CURRENT_WEATHER_LEVEL",
    )


@query(
    "c8_levels_by_statistic",
    f"""WITH {E}, s AS (SELECT SAMPLE_POINT_NAME, count(*) AS n FROM e GROUP BY ALL)
  SELECT SAMPLE_POINT_NAME, n, row_number() OVER (ORDER BY n DESC, SAMPLE_POINT_NAME) AS level_rank FROM s""",
)
def _(spark, sf):
    sizes = b.event_samples(spark, sf).groupBy("SAMPLE_POINT_NAME").agg(
        F.count(F.lit(1)).alias("n")
    )
    return rank_levels(sizes, "SAMPLE_POINT_NAME", "n", desc=True)


@query(
    "c9_harmonised_covariates",
    f"WITH {b.WIDE_SQL} SELECT {b.KEYS_SQL}, ACCUMULATION, PAST_WEATHER FROM w",
)
def _(spark, sf):
    return harmonise(b.wide_samples(spark, sf)).select(
        "SAMPLE_POINT_NAME", "DEP_SAMPLE_ID", "SAMPLE_DATE", "ACCUMULATION", "PAST_WEATHER"
    )


@query(
    "c10_cap",
    "SELECT o_orderkey, round(CASE WHEN o_totalprice > 400000 THEN 400000 ELSE o_totalprice END, 6) AS capped FROM orders",
)
def _(spark, sf):
    capped = cap("o_totalprice", 400000.0)
    return rounded(b.table(spark, sf, "orders").select("o_orderkey", capped.alias("capped")))


@query(
    "c11_masked_overwrite",
    f"""WITH {O} SELECT id, coalesce((SAMPLE_POINT_NAME = 'NATION_2' AND YEAR = 1996 AND dayofweek(SAMPLE_DATE) = 1)
  OR (SAMPLE_POINT_NAME = 'NATION_2' AND YEAR = 1997 AND dayofweek(SAMPLE_DATE) = 4), false) OR RESAMPLE AS RESAMPLE FROM o""",
)
def _(spark, sf):
    rules = [
        {"SAMPLE_POINT_NAME": "NATION_2", "YEAR": 1996, "WEEKDAY": "Mon"},
        {"SAMPLE_POINT_NAME": "NATION_2", "YEAR": 1997, "WEEKDAY": "Thu"},
    ]
    return override(b.calendar_orders(spark, sf), rules, "RESAMPLE", True).select("id", "RESAMPLE")


# --- flags -------------------------------------------------------------------------------


def _flag_lists(spark, sf):
    samples = b.order_samples(spark, sf)
    stn = F.col("SAMPLE_POINT_NAME").alias("stn")
    return (
        samples.drop("RESAMPLE", "OTHER"),
        samples.filter("RESAMPLE").select("id", stn),
        samples.filter("OTHER").select("id", stn),
    )


@query("g1_assign_flags", f"WITH {O} SELECT id, SAMPLE_POINT_NAME, RESAMPLE, OTHER FROM o")
def _(spark, sf):
    samples, resamples, others = _flag_lists(spark, sf)
    flagged = assign_flags(samples, resamples, others)
    return flagged.select("id", "SAMPLE_POINT_NAME", "RESAMPLE", "OTHER")


EDITS_SQL = """edits AS (SELECT CASE WHEN event_type IN ('click', 'error') THEN 'resample' ELSE 'other' END AS list,
  event_id AS step, user_id AS id, CAST(user_id AS VARCHAR) AS stn,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'add' ELSE 'remove' END AS op FROM events)"""


def _edits(spark, sf):
    kind = F.col("event_type")
    return b.table(spark, sf, "events").select(
        F.when(kind.isin("click", "error"), "resample").otherwise("other").alias("list"),
        F.col("event_id").alias("step"),
        F.col("user_id").alias("id"),
        F.col("user_id").cast("string").alias("stn"),
        F.when(kind.isin("click", "purchase"), "add").otherwise("remove").alias("op"),
    )


@query(
    "g2_flag_ledger",
    f"""WITH {EDITS_SQL}, l AS (SELECT list, id, arg_max(op, step) AS op, arg_max(stn, step) AS stn
  FROM edits GROUP BY list, id) SELECT list, id, stn FROM l WHERE op = 'add'""",
)
def _(spark, sf):
    return fold_ledger(_edits(spark, sf))


@query(
    "g3_members",
    "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def _(spark, sf):
    late = b.table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    ids = late.select(F.col("o_custkey").alias("c_custkey"))
    return members(b.table(spark, sf, "customer"), ids, "c_custkey")


@query(
    "g3_non_members",
    """SELECT user_id, event_id FROM events WHERE user_id NOT IN
  (SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 300)""",
)
def _(spark, sf):
    events = b.table(spark, sf, "events").select("user_id", "event_id", "value")
    high = events.groupBy("user_id").agg(F.max("value").alias("top")).filter("top > 300")
    return non_members(events.drop("value"), high, "user_id")


# --- checks ------------------------------------------------------------------------------


@query(
    "q1_ambiguous_stations",
    f"""WITH {b.SUPPLIER_SQL}, d AS (SELECT DISTINCT * FROM sp),
  k AS (SELECT *, count(*) OVER (PARTITION BY SAMPLE_POINT_NAME) AS n FROM d)
  SELECT SITE_NAME, SAMPLE_POINT_NAME, SITE_LATITUDE_UTM, SITE_LONGITUDE_UTM, n FROM k WHERE n > 1""",
)
def _(spark, sf):
    return checks.ambiguous_stations(b.supplier_points(spark, sf))


@query(
    "q2_unmatched_keys",
    f"""WITH {b.RAW_SQL}, {b.CATEGORIES_SQL}, {b.NUMERIC_SQL} SELECT DISTINCT {b.KEYS_SQL} FROM cat
  WHERE ({b.KEYS_SQL}) NOT IN (SELECT ({b.KEYS_SQL}) FROM num)""",
)
def _(spark, sf):
    clean = b.clean_rows(spark, sf)
    keys = list(b.KEYS_SQL.split(", "))
    categorical = extract_categories(clean).select(*keys).distinct()
    return checks.unmatched_keys(categorical, extract_numeric(clean), keys)


def _bad_flags(spark, sf):
    """Every error event as a flag; those above 104 shifted to ids and points that do not
    exist or differ, those at or below 10 listed twice."""
    flags = b.event_samples(spark, sf).filter("RESAMPLE").select(
        F.when(F.col("ENTEROCOCCI") > 200, -F.col("id") - 1).otherwise(F.col("id")).alias("id"),
        F.when(F.col("ENTEROCOCCI") > 104, F.concat(F.lit("X"), "SAMPLE_POINT_NAME"))
        .otherwise(F.col("SAMPLE_POINT_NAME"))
        .alias("stn"),
        "ENTEROCOCCI",
    )
    twice = flags.filter("ENTEROCOCCI <= 10")
    return flags.unionByName(twice).drop("ENTEROCOCCI")


BAD_FLAGS_SQL = """f0 AS (SELECT CASE WHEN ENTEROCOCCI > 200 THEN -id - 1 ELSE id END AS id,
  CASE WHEN ENTEROCOCCI > 104 THEN 'X' || SAMPLE_POINT_NAME ELSE SAMPLE_POINT_NAME END AS stn, ENTEROCOCCI
  FROM e WHERE RESAMPLE), f AS (SELECT id, stn FROM f0 UNION ALL SELECT id, stn FROM f0 WHERE ENTEROCOCCI <= 10)"""


@query(
    "q3_dangling_flags",
    f"WITH {E}, {BAD_FLAGS_SQL} SELECT id, stn FROM f WHERE id NOT IN (SELECT id FROM e)",
)
def _(spark, sf):
    return checks.dangling_flags(_bad_flags(spark, sf), b.event_samples(spark, sf))


@query(
    "q4_inconsistent_flags",
    f"""WITH {E}, {BAD_FLAGS_SQL} SELECT f.id, stn AS flag_point, SAMPLE_POINT_NAME AS sample_point,
  'point differs' AS reason FROM f JOIN e USING (id) WHERE stn <> SAMPLE_POINT_NAME
  UNION ALL SELECT f.id, min(stn), min(SAMPLE_POINT_NAME), 'duplicate' FROM f JOIN e USING (id)
  GROUP BY f.id HAVING count(*) > 1""",
)
def _(spark, sf):
    return checks.inconsistent_flags(_bad_flags(spark, sf), b.event_samples(spark, sf))


@query(
    "q5_flag_count_gap",
    f"""WITH {E}, {BAD_FLAGS_SQL}, t AS (SELECT (SELECT count(*) FROM f) AS expected,
  (SELECT count(*) FROM e WHERE RESAMPLE) AS actual) SELECT * FROM t WHERE expected <> actual""",
)
def _(spark, sf):
    return checks.flag_count_gap(_bad_flags(spark, sf), b.event_samples(spark, sf), "RESAMPLE")


@query(
    "q6_multiple_per_day",
    f"""WITH {E} SELECT SAMPLE_POINT_NAME, CAST(CAST(SAMPLE_DATE AS DATE) AS VARCHAR) AS DATE, count(*) AS n FROM e
  GROUP BY ALL HAVING count(*) > 1""",
)
def _(spark, sf):
    return rounded(checks.multiple_per_day(b.event_samples(spark, sf)))


@query(
    "q7_resample_without_exceedance",
    f"""WITH {O}, l AS (SELECT *, lag(GT_104) OVER (PARTITION BY SAMPLE_POINT_NAME ORDER BY SAMPLE_DATE, id) AS prev FROM o)
  SELECT SAMPLE_POINT_NAME, id, SAMPLE_DATE, {b.calweek_sql('SAMPLE_DATE')} AS WEEK FROM l WHERE RESAMPLE AND prev = 0""",
)
def _(spark, sf):
    return checks.resample_without_exceedance(
        b.order_samples(spark, sf), limits=b.ORDER_LIMITS
    )


@query(
    "q8_duplicate_cells",
    """SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events
  GROUP BY ALL HAVING count(*) > 1""",
)
def _(spark, sf):
    events = b.table(spark, sf, "events").withColumn("day", F.to_date(F.col("ts")))
    return rounded(checks.duplicate_cells(events, ["user_id", "day"], "event_type"))


# --- dimensions ----------------------------------------------------------------------------


@query(
    "j2_attach_station",
    f"WITH {O} SELECT o.id, o.SAMPLE_POINT_NAME, st.TOWN, st.SITE_NAME AS BEACH_NAME FROM o LEFT JOIN st ON o.SAMPLE_POINT_NAME = st.SAMPLE_POINT_NAME",
)
def _(spark, sf):
    samples = b.order_samples(spark, sf).select("id", "SAMPLE_POINT_NAME")
    return stations.attach_station(samples, b.nations(spark, sf), beach="BEACH_NAME")


STATS_SQL = """stats AS (SELECT SAMPLE_POINT_NAME, count(*) AS COUNT,
  round(avg(CAST(ENTEROCOCCI > 350000 AS INTEGER)), 6) AS FRAC_GT_BAV,
  round(quantile_cont(ENTEROCOCCI, 0.5), 6) AS MEDIAN FROM o GROUP BY ALL)"""


@query(
    "j3_station_statistics",
    f"""WITH {O}, {STATS_SQL} SELECT SAMPLE_POINT_NAME, TOWN, COUNT, FRAC_GT_BAV, MEDIAN FROM st
  LEFT JOIN stats USING (SAMPLE_POINT_NAME)""",
)
def _(spark, sf):
    stats = site_statistics(b.order_samples(spark, sf), limits=b.ORDER_LIMITS)
    joined = stations.station_stats_dim(b.nations(spark, sf), stats)
    return rounded(joined.select("SAMPLE_POINT_NAME", "TOWN", "COUNT", "FRAC_GT_BAV", "MEDIAN"))


SPINE_SQL = f"""days AS (SELECT YEAR, unnest(generate_series(make_date(YEAR, 1, 1)::TIMESTAMP, make_date(YEAR, 12, 31)::TIMESTAMP,
  INTERVAL 1 DAY)) AS d FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS YEAR FROM orders)),
  wk AS (SELECT YEAR, d, {b.calweek_sql('d')} AS WEEK FROM days),
  spine AS (SELECT YEAR, WEEK, CAST(CAST(min(d) AS DATE) AS VARCHAR) AS START_DATE, strftime(min(d), '%b %d') AS START_LABEL,
  CAST(WEEK - 22 AS INTEGER) AS label_rank FROM wk WHERE WEEK BETWEEN 23 AND 36 GROUP BY YEAR, WEEK)"""


@query("d4_week_spine", f"WITH {SPINE_SQL} SELECT * FROM spine")
def _(spark, sf):
    years = b.table(spark, sf, "orders").select(F.year("o_orderdate").alias("YEAR"))
    return rounded(stations.week_spine(years))


@query(
    "j4_attach_week_labels",
    f"""WITH {SPINE_SQL}, o1 AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS YEAR,
  {b.calweek_sql('o_orderdate')} AS WEEK FROM orders)
  SELECT YEAR, WEEK, o_orderkey, START_DATE, START_LABEL FROM o1 LEFT JOIN spine USING (YEAR, WEEK)""",
)
def _(spark, sf):
    orders = b.table(spark, sf, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("YEAR"), calweek("o_orderdate").alias("WEEK")
    )
    return rounded(stations.attach_weeks(orders, stations.week_spine(orders)))


def _latlon_sql() -> str:
    scale = repr(geo.SCALE_FACTOR * geo.RECTIFYING_RADIUS)
    return f"""grid AS (SELECT *, SITE_LATITUDE_UTM / CAST('{scale}' AS DOUBLE) AS xi,
    (SITE_LONGITUDE_UTM - 500000e0) / CAST('{scale}' AS DOUBLE) AS eta FROM sp),
  sphere AS (SELECT *, xi - ({_cast_series(geo.BETA, 'sin(xi * {k}) * cosh(eta * {k})')}) AS xs,
    eta - ({_cast_series(geo.BETA, 'cos(xi * {k}) * sinh(eta * {k})')}) AS es FROM grid),
  conf AS (SELECT *, asin(sin(xs) / cosh(es)) AS chi FROM sphere),
  ll AS (SELECT *, (chi + {_cast_series(geo.DELTA, 'sin(chi * {k})')}) * CAST('{180 / math.pi!r}' AS DOUBLE) AS LATITUDE,
    atan2(sinh(es), cos(xs)) * CAST('{180 / math.pi!r}' AS DOUBLE) - 69e0 AS LONGITUDE FROM conf)"""


def _cast_series(coefficients, term: str) -> str:
    return " + ".join(
        f"CAST('{c!r}' AS DOUBLE) * {term.format(k=f'{2 * j}e0')}"
        for j, c in enumerate(coefficients, 1)
    )


@query(
    "x1_station_latlon",
    f"""WITH {b.SUPPLIER_SQL}, {_latlon_sql()} SELECT SITE_SEQUENCE_NUMBER, TOWN, SITE_NAME,
  SAMPLE_POINT_NAME, round(LATITUDE, 6) AS LATITUDE, round(LONGITUDE, 6) AS LONGITUDE FROM ll""",
)
def _(spark, sf):
    return rounded(geo.add_latlon(b.supplier_points(spark, sf)))


@query(
    "x1_station_dimension",
    f"""WITH {b.RAW_SQL}, sp AS (SELECT DISTINCT SITE_SEQUENCE_NUMBER, TOWN, SITE_NAME, SAMPLE_POINT_NAME,
  SITE_LATITUDE_UTM, SITE_LONGITUDE_UTM FROM c), {_latlon_sql()}
  SELECT SITE_SEQUENCE_NUMBER, TOWN, SITE_NAME, SAMPLE_POINT_NAME, round(LATITUDE, 6) AS LATITUDE,
  round(LONGITUDE, 6) AS LONGITUDE FROM ll""",
)
def _(spark, sf):
    return rounded(stations.build_stations(b.typed(spark, sf)))


@query(
    "x2_station_choices",
    f"""WITH {b.SUPPLIER_SQL} SELECT SAMPLE_POINT_NAME, coalesce(TOWN, 'NA') || ' - ' || coalesce(SITE_NAME, 'NA')
  || ' - ' || coalesce(SAMPLE_POINT_NAME, 'NA') AS LABEL FROM sp""",
)
def _(spark, sf):
    return stations.station_choices(b.supplier_points(spark, sf))
