"""IO, N, L, R, J1, W1, D, F1: raw rows to the sample table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.functions.calendar import add_calendar, calweek, in_season
from strandline.model import (
    CATEGORICAL_NAMES,
    CATEGORY_RULES,
    NUMERIC_NAMES,
    NUMERIC_RULES,
    RAW_COLUMNS,
    SAMPLE_DEPTH_RULE,
    SAMPLE_KEYS,
)
from strandline.operators.joins import KEY, as_columns
from strandline.operators.ranking import row_numbers
from strandline.operators.reshape import (
    pivot_fill,
    pivot_strict,
    record_as_rows,
    stack,
    unlisted,
    unpivot,
)
from strandline.plans.assembly import (
    assign_ids,
    build_samples,
    extract_categories,
    extract_numeric,
    merge_variables,
    substitute_nondetects,
    widen,
    with_result,
)
from strandline.plans.ingest import (
    dedup_rows,
    distinct_values,
    standardise_names,
    standardise_types,
)
from strandline.queries import bindings as b
from strandline.queries.registry import query, rounded
from strandline.session import shared_dir
from strandline.sources.tables import (
    read_flags,
    read_raw,
    read_stage,
    write_csv,
    write_stage,
)


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"


RAW_OUT_SQL = f"""SELECT c_nationkey || '.0' AS SITE_SEQUENCE_NUMBER, CAST(o_orderkey AS VARCHAR) AS SAMPLE_SEQUENCE_NUMBER,
  TOWN, chr(9) || ' ' || SITE_NAME || '  ' AS SITE_NAME, pt AS SAMPLE_POINT_NAME, o_orderdate AS SAMPLE_DATE,
  kind AS SAMPLE_TYPE, 'D' || o_orderkey AS DEP_SAMPLE_ID, pname AS PARAMETER_NAME, conc AS CONCENTRATION,
  qual AS CONCENTRATION_QUALIFIER, lim AS QUANITATION_LIMIT,
  CAST(4770000 + c_nationkey * 1000 AS VARCHAR) AS SITE_LATITUDE_UTM,
  CAST(300000 + c_nationkey * 3000 AS VARCHAR) AS SITE_LONGITUDE_UTM FROM p"""


@query("io1_raw_scan", f"WITH {b.RAW_SQL} {RAW_OUT_SQL}")
def _(spark, sf):
    path = _scratch(spark, "raw")
    raw = b.raw_rows(spark, sf)
    # Raw rows repeat their names and sites: plain text would be many times the orders' size.
    write_csv(raw.select(*[F.col(f"`{c}`") for c in RAW_COLUMNS]), path, compression="gzip")
    return standardise_names(read_raw(spark, path), drop=["REMARKS"])


@query(
    "io2_flag_list_scan",
    "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS stn FROM events WHERE event_type = 'error'",
)
def _(spark, sf):
    path = _scratch(spark, "flags")
    flags = b.event_samples(spark, sf).filter("RESAMPLE")
    write_csv(flags.select("id", F.col("SAMPLE_POINT_NAME").alias("stn")), path)
    return read_flags(spark, path)


STAGE_SQL = f"""WITH {b.ORDERS_SQL} SELECT id, SAMPLE_POINT_NAME, SAMPLE_DATE,
  ENTEROCOCCI, RESAMPLE, OTHER, YEAR FROM o"""


@query("io3_stage_scan", STAGE_SQL)
def _(spark, sf):
    path = _scratch(spark, "stage")
    write_stage(b.order_samples(spark, sf).drop("SITE_NAME"), path, ["YEAR"])
    return read_stage(spark, path)


@query("io4_csv_export", f"WITH {b.EVENTS_SQL} SELECT id, SAMPLE_POINT_NAME, ENTEROCOCCI FROM e")
def _(spark, sf):
    path = _scratch(spark, "csv")
    samples = b.event_samples(spark, sf).select("id", "SAMPLE_POINT_NAME", "ENTEROCOCCI")
    write_csv(samples, path)
    back = spark.read.schema(samples.schema).option("header", True).csv(path)
    return rounded(back)


@query("io5_stage_snapshot", STAGE_SQL)
def _(spark, sf):
    path = _scratch(spark, "snapshot")
    write_stage(b.order_samples(spark, sf).drop("SITE_NAME"), path, ["YEAR"])
    return read_stage(spark, path)


@query("n1_canonical_names", f"WITH {b.RAW_SQL} {RAW_OUT_SQL}")
def _(spark, sf):
    raw = b.raw_rows(spark, sf)
    return standardise_names(raw, drop=[raw.columns.index("REMARKS")])


@query(
    "n2_tolerant_types",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'view' THEN '<10' WHEN event_type = 'click' THEN '  '
  ELSE CAST(floor(value) AS BIGINT) || '.5' END AS DOUBLE) AS number,
  CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE CAST(floor(value) AS INTEGER) END AS whole,
  'x ' || event_type AS label FROM events""",
)
def _(spark, sf):
    whole = F.concat(F.floor("value").cast("string"), F.lit(".5"))
    text = (
        F.when(F.col("event_type") == "view", "<10")
        .when(F.col("event_type") == "click", "  ")
        .otherwise(whole)
    )
    padded = F.concat(F.lit(" \t\nx "), "event_type", F.lit("\t "))
    typed = b.table(spark, sf, "events").select(
        "event_id", text.alias("number"), text.alias("whole"), padded.alias("label")
    )
    return standardise_types(typed, {"number": "number", "whole": "integer", "label": "trim"})


@query(
    "n3_whole_row_dedup",
    """SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_returnflag FROM (
  SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)""",
)
def _(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"]
    items = b.table(spark, sf, "lineitem").select(*cols)
    return dedup_rows(stack(items, items))


@query("n4_distinct_values", f"WITH {b.RAW_SQL} SELECT DISTINCT PARAMETER_NAME FROM c")
def _(spark, sf):
    return distinct_values(b.clean_rows(spark, sf), "PARAMETER_NAME")


@query(
    "n4_distinct_sites",
    f"WITH {b.ORDERS_SQL} SELECT DISTINCT SAMPLE_POINT_NAME FROM o",
)
def _(spark, sf):
    return distinct_values(b.order_samples(spark, sf), "SAMPLE_POINT_NAME")


@query(
    "n_standardised_rows",
    f"""WITH {b.RAW_SQL} SELECT DISTINCT * FROM c""",
)
def _(spark, sf):
    return b.clean_rows(spark, sf)


@query(
    "l1_category_extraction",
    f"WITH {b.RAW_SQL}, {b.CATEGORIES_SQL} SELECT * FROM cat",
)
def _(spark, sf):
    return extract_categories(b.clean_rows(spark, sf))


@query(
    "l1_sample_depth",
    f"""WITH {b.RAW_SQL} SELECT {b.KEYS_SQL}, 'SAMPLE_DEPTH_INTERVAL' AS PARAMETER_NAME,
  replace(PARAMETER_NAME, 'SAMPLE DEPTH INTERVAL ', '') AS VALUE FROM c
  WHERE PARAMETER_NAME LIKE '%SAMPLE DEPTH INTERVAL%'""",
)
def _(spark, sf):
    return extract_categories(b.clean_rows(spark, sf), [SAMPLE_DEPTH_RULE])


@query(
    "l2_compound_rule",
    f"""WITH {b.RAW_SQL}, {b.CATEGORIES_SQL} SELECT PARAMETER_NAME, VALUE, count(*) AS n FROM cat
  WHERE PARAMETER_NAME IN ('CURRENT', 'WATER_SURFACE') GROUP BY ALL""",
)
def _(spark, sf):
    compound = [rule for rule in CATEGORY_RULES if rule.ends_with]
    found = extract_categories(b.clean_rows(spark, sf), compound)
    return found.groupBy("PARAMETER_NAME", "VALUE").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l3_numeric_extraction",
    f"WITH {b.RAW_SQL}, {b.NUMERIC_SQL} SELECT * FROM num WHERE PARAMETER_NAME <> 'ENTEROCOCCI'",
)
def _(spark, sf):
    measured = [rule for rule in NUMERIC_RULES if not rule.nondetect]
    return extract_numeric(b.clean_rows(spark, sf), measured)


@query(
    "l3_unlisted_names",
    f"""WITH {b.RAW_SQL}, {b.NUMERIC_SQL} SELECT * FROM num
  WHERE PARAMETER_NAME = 'ACCUMULATION LAST 72 HOURS'""",
)
def _(spark, sf):
    return unlisted(extract_numeric(b.clean_rows(spark, sf)), "PARAMETER_NAME", NUMERIC_NAMES)


@query(
    "l4_nondetect_substitution",
    f"""WITH {b.RAW_SQL}, {b.NUMERIC_SQL} SELECT * FROM num WHERE PARAMETER_NAME = 'ENTEROCOCCI'""",
)
def _(spark, sf):
    return extract_numeric(
        b.clean_rows(spark, sf), [rule for rule in NUMERIC_RULES if rule.nondetect]
    )


@query(
    "l4_limit_for_low_values",
    "SELECT event_id, CASE WHEN value < 10 THEN 10.0e0 ELSE round(value, 6) END AS VALUE FROM events",
)
def _(spark, sf):
    token = F.when(F.col("value") < 10, "ND")
    events = b.table(spark, sf, "events").withColumns({"q": token, "lim": F.lit(10.0)})
    value = substitute_nondetects("value", "q", "lim", "ND")
    return rounded(events.select("event_id", value.alias("VALUE")))


@query(
    "l5_stack",
    """SELECT c_nationkey AS nation, 'customer' AS kind, count(*) AS n FROM customer GROUP BY ALL
  UNION ALL SELECT s_nationkey, 'supplier', count(*) FROM supplier GROUP BY ALL""",
)
def _(spark, sf):
    customer, supplier = b.table(spark, sf, "customer"), b.table(spark, sf, "supplier")
    both = stack(
        customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")),
        supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation")),
    )
    return both.groupBy("nation", "kind").agg(F.count(F.lit(1)).alias("n"))


# --- pivots over users and days -------------------------------------------------

TYPES = ["click", "error", "purchase", "signup", "view"]
CELLS_SQL = """cells AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, max(value) AS value
  FROM events GROUP BY ALL)"""


def _cells(spark, sf):
    events = b.table(spark, sf, "events")
    return events.groupBy(
        "user_id", F.to_date(F.col("ts")).alias("day"), "event_type"
    ).agg(F.max("value").alias("value"))


def _pivot_cells_sql(types, fill=""):
    return ", ".join(
        f"round({'coalesce(' if fill else ''}max(CASE WHEN event_type = '{t}' THEN value END)"
        f"{fill}, 6) AS \"{t}\""
        for t in types
    )


@query(
    "r1_strict_pivot",
    f"WITH {CELLS_SQL} SELECT user_id, day, {_pivot_cells_sql(TYPES)} FROM cells GROUP BY ALL",
)
def _(spark, sf):
    return rounded(pivot_strict(_cells(spark, sf), ["user_id", "day"], "event_type", "value", TYPES))


@query(
    "r2_pivot_with_fill",
    f"WITH {CELLS_SQL} SELECT user_id, day, {_pivot_cells_sql(TYPES, ', 0)')} FROM cells GROUP BY ALL",
)
def _(spark, sf):
    wide = pivot_fill(
        _cells(spark, sf), ["user_id", "day"], "event_type", "value", TYPES, fill=0.0
    )
    return rounded(wide)


@query(
    "r3_unpivot_known",
    f"""WITH {b.WIDE_SQL}, u AS (UNPIVOT (SELECT {b.KEYS_SQL}, {', '.join(NUMERIC_NAMES)} FROM w0)
  ON {', '.join(NUMERIC_NAMES)} INTO NAME PARAMETER_NAME VALUE VALUE)
  SELECT {b.KEYS_SQL}, PARAMETER_NAME, VALUE FROM u""",
)
def _(spark, sf):
    return unpivot(widen(b.typed(spark, sf)), SAMPLE_KEYS, NUMERIC_NAMES, drop_null=True)


@query(
    "r4_unpivot_all",
    f"""WITH {b.WIDE_SQL} SELECT {b.KEYS_SQL}, 'TIDE' AS PARAMETER_NAME, TIDE AS VALUE FROM w0
  UNION ALL SELECT {b.KEYS_SQL}, 'CURRENT', CURRENT FROM w0""",
)
def _(spark, sf):
    return unpivot(widen(b.typed(spark, sf)), SAMPLE_KEYS, ["TIDE", "CURRENT"])


@query(
    "r5_record_as_rows",
    """SELECT s_suppkey, 'Name' AS FIELD, s_name AS VALUE FROM supplier
  UNION ALL SELECT s_suppkey, 'Nation', CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT s_suppkey, 'Balance', CAST(round(s_acctbal, 6) AS VARCHAR) FROM supplier""",
)
def _(spark, sf):
    labels = {"s_name": "Name", "s_nationkey": "Nation", "s_acctbal": "Balance"}
    return record_as_rows(b.table(spark, sf, "supplier"), labels, ["s_suppkey"])


# --- merge and ids -----------------------------------------------------------------

WIDE_COLUMNS_SQL = f"{b.KEYS_SQL}, {', '.join(CATEGORICAL_NAMES + NUMERIC_NAMES)}"


def _two_sides(spark, sf):
    """Both wide tables by ``KEY``: distinct rows, pivots and a merge share one shuffle by sample."""
    clean = b.clean_rows(spark, sf, SAMPLE_KEYS)
    categorical = pivot_strict(
        extract_categories(clean, keys=[KEY]), [KEY], "PARAMETER_NAME", "VALUE", CATEGORICAL_NAMES
    )
    numeric = pivot_strict(
        extract_numeric(clean, keys=[KEY]), [KEY], "PARAMETER_NAME", "VALUE", NUMERIC_NAMES
    )
    return categorical, numeric


@query("j1_full_outer_merge", f"WITH {b.WIDE_SQL} SELECT {WIDE_COLUMNS_SQL}, NUMERIC_ONLY FROM w0")
def _(spark, sf):
    return as_columns(merge_variables(*_two_sides(spark, sf), keys=[KEY]))


@query(
    "j1_events_merge",
    f"""WITH {CELLS_SQL}, l AS (SELECT user_id, day, {_pivot_cells_sql(['click', 'view'])} FROM cells
  WHERE event_type IN ('click', 'view') GROUP BY ALL),
  r AS (SELECT user_id, day, {_pivot_cells_sql(['error', 'purchase', 'signup'])} FROM cells
  WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY ALL)
  SELECT user_id, day, click, "view", error, purchase, signup, l.click IS NULL AND l."view" IS NULL AS NUMERIC_ONLY
  FROM l FULL OUTER JOIN r USING (user_id, day)""",
)
def _(spark, sf):
    cells, keys = _cells(spark, sf), ["user_id", "day"]
    left, right = (
        pivot_strict(cells.filter(F.col("event_type").isin(*types)), keys, "event_type", "value", types)
        for types in (["click", "view"], ["error", "purchase", "signup"])
    )
    return rounded(merge_variables(left, right, keys))


@query("j1_single_pivot", f"WITH {b.WIDE_SQL} SELECT {WIDE_COLUMNS_SQL}, NUMERIC_ONLY FROM w0")
def _(spark, sf):
    return widen(b.typed(spark, sf))


IDS_SQL = """ids AS (SELECT *, row_number() OVER (ORDER BY NUMERIC_ONLY, SAMPLE_POINT_NAME,
  CASE WHEN NOT NUMERIC_ONLY THEN DEP_SAMPLE_ID END, SAMPLE_DATE, DEP_SAMPLE_ID) AS id FROM w0)"""


@query(
    "w1_surrogate_ids",
    f"WITH {b.WIDE_SQL}, {IDS_SQL} SELECT {b.KEYS_SQL}, NUMERIC_ONLY, id FROM ids",
)
def _(spark, sf):
    merged = widen(b.typed(spark, sf)).select(*SAMPLE_KEYS, "NUMERIC_ONLY")
    return assign_ids(merged)


@query(
    "w1_order_ids",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS id
  FROM orders""",
)
def _(spark, sf):
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    order = [F.col(c).asc_nulls_last() for c in ("o_custkey", "o_orderdate", "o_orderkey")]
    return row_numbers(orders, order, name="id").select("o_orderkey", "id")


@query(
    "sample_table",
    f"""WITH {b.WIDE_SQL}, {IDS_SQL}, cal AS (SELECT *, {b.calweek_sql('SAMPLE_DATE')} AS wk FROM ids)
  SELECT {WIDE_COLUMNS_SQL}, id, CAST(year(SAMPLE_DATE) AS INTEGER) AS YEAR,
  CAST(month(SAMPLE_DATE) AS INTEGER) AS MONTH, CASE WHEN wk BETWEEN 20 AND 46 THEN wk END AS WEEK,
  {b.weekday_sql('SAMPLE_DATE')} AS WEEKDAY, CAST(CAST(SAMPLE_DATE AS DATE) AS VARCHAR) AS DATE
  FROM cal WHERE ENTEROCOCCI IS NOT NULL""",
)
def _(spark, sf):
    return rounded(build_samples(b.typed(spark, sf)))


# --- calendar ------------------------------------------------------------------------


@query(
    "d1_calendar",
    f"""WITH o1 AS (SELECT *, {b.calweek_sql('o_orderdate')} AS wk FROM orders)
  SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS YEAR, CAST(month(o_orderdate) AS INTEGER) AS MONTH,
  CASE WHEN wk BETWEEN 20 AND 46 THEN wk END AS WEEK, {b.weekday_sql('o_orderdate')} AS WEEKDAY,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS DATE FROM o1""",
)
def _(spark, sf):
    dated = add_calendar(b.table(spark, sf, "orders"), "o_orderdate")
    return rounded(dated.select("o_orderkey", "YEAR", "MONTH", "WEEK", "WEEKDAY", "DATE"))


@query(
    "d2_week_of_year",
    f"SELECT l_shipdate, {b.calweek_sql('l_shipdate')} AS WEEK, count(*) AS n FROM lineitem GROUP BY ALL",
)
def _(spark, sf):
    items = b.table(spark, sf, "lineitem").groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    return items.withColumn("WEEK", calweek("l_shipdate"))


@query(
    "d3_season_window",
    f"""WITH o1 AS (SELECT o_orderkey, {b.calweek_sql('o_orderdate')} AS wk FROM orders)
  SELECT o_orderkey, CASE WHEN wk BETWEEN 20 AND 46 THEN wk END AS WEEK FROM o1""",
)
def _(spark, sf):
    week = in_season(calweek("o_orderdate"))
    return b.table(spark, sf, "orders").select("o_orderkey", week.alias("WEEK"))


@query(
    "f1_rows_with_result",
    f"WITH {b.WIDE_SQL} SELECT {b.KEYS_SQL}, ENTEROCOCCI FROM w0 WHERE ENTEROCOCCI IS NOT NULL",
)
def _(spark, sf):
    kept = with_result(widen(b.typed(spark, sf)))
    return kept.select(*SAMPLE_KEYS, "ENTEROCOCCI")
