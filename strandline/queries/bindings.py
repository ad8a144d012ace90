"""The given tables in the roles of the domain, for Spark and as SQL common tables.

``events_samples``  users as sites over one month, true limits 70 / 104;
``order_samples``   nations as sites over seven years, limits at similar shares;
``raw_rows``        about twelve raw measurement rows per order, every trap included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.calendar import add_calendar
from strandline.functions.classify import decorate
from strandline.model import NONDETECT_QUALIFIER, Limits
from strandline.plans.assembly import widen, with_result
from strandline.plans.ingest import standardise, typed_rows

ORDER_LIMITS = Limits(350000.0, 425000.0)
EVENT_SEASON = (2, 4)


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table under its declared schema, which saves a job that reads footers."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


#: Orders in one task; each gives about a dozen raw rows, which a task may sort or hash whole.
ORDERS_PER_TASK = 50_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """All cores at least, and tasks of about ``ORDERS_PER_TASK`` of ``rows``."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ORDERS_PER_TASK))


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Use all cores for a row-multiplying step, in tasks of about ``ORDERS_PER_TASK`` of ``rows``.

    Splits and joined partitions go by compressed bytes: one may hold many millions of rows.
    """
    return df.repartition(tasks_for(df.sparkSession, rows))


# --- events -------------------------------------------------------------------


def event_samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("SAMPLE_POINT_NAME"),
        F.col("ts").alias("SAMPLE_DATE"),
        F.col("value").alias("ENTEROCOCCI"),
        (F.col("event_type") == "error").alias("RESAMPLE"),
        (F.col("event_type") == "signup").alias("OTHER"),
        F.year("ts").alias("YEAR"),
    )


def decorated_events(spark: SparkSession, sf: str) -> DataFrame:
    return decorate(event_samples(spark, sf))


def calendar_events(spark: SparkSession, sf: str) -> DataFrame:
    return add_calendar(decorated_events(spark, sf), season=EVENT_SEASON)


CALWEEK_SQL = """CASE WHEN (dayofyear({d} + INTERVAL 1 DAY * dayofweek(date_trunc('year', {d}))) - 1) // 7 + 1 = 1
  AND month({d}) = 12 THEN 53
  ELSE (dayofyear({d} + INTERVAL 1 DAY * dayofweek(date_trunc('year', {d}))) - 1) // 7 + 1 END"""


def calweek_sql(d: str) -> str:
    return f"CAST({CALWEEK_SQL.format(d=d)} AS INTEGER)"


def weekday_sql(d: str) -> str:
    return f"['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'][dayofweek({d}) + 1]"


SAMPLE_TYPE_SQL = (
    "CASE WHEN RESAMPLE THEN 'Resample' WHEN OTHER THEN 'Irregular' ELSE 'Routine' END"
)


def class_sql(lo: float, hi: float, lowest: str, x: str = "ENTEROCOCCI") -> str:
    known = f"{x} IS NULL OR isnan({x}) THEN NULL"
    return (
        f"CASE WHEN {known} WHEN {x} > {hi:.0f} THEN '>104' WHEN {x} > {lo:.0f} THEN '70-104' "
        f"ELSE '{lowest}' END"
    )


def _decorated_sql(name: str, source: str, lo: float, hi: float) -> str:
    return f"""{name} AS (SELECT *,
  CASE WHEN NOT isnan(ENTEROCOCCI) THEN CAST(ENTEROCOCCI > {hi:.0f} AS INTEGER) END AS GT_104,
  CASE WHEN NOT isnan(ENTEROCOCCI) THEN CAST(ENTEROCOCCI > {lo:.0f} AS INTEGER) END AS GT_70,
  {class_sql(lo, hi, '<=70')} AS CLASS,
  {SAMPLE_TYPE_SQL} AS SAMPLE_TYPE,
  NOT RESAMPLE AND NOT OTHER AS routine
  FROM {source})"""


EVENTS_SQL = (
    """e0 AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS SAMPLE_POINT_NAME,
  ts AS SAMPLE_DATE, value AS ENTEROCOCCI, event_type = 'error' AS RESAMPLE,
  event_type = 'signup' AS OTHER, CAST(year(ts) AS INTEGER) AS YEAR FROM events), """
    + _decorated_sql("e", "e0", 70, 104)
)

# --- orders -------------------------------------------------------------------


def nations(spark: SparkSession, sf: str) -> DataFrame:
    """Nation and region as site, town and beach."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey",
        F.col("n_name").alias("SAMPLE_POINT_NAME"),
        F.col("r_name").alias("SITE_NAME"),
        F.concat(F.lit("Town of "), "n_name").alias("TOWN"),
    )


def order_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as samples of nations; joined by size, the large side stays in place."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    site = nations(spark, sf).select("n_nationkey", "SAMPLE_POINT_NAME", "SITE_NAME")
    joined = orders.join(
        customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    ).join(site, F.col("c_nationkey") == F.col("n_nationkey"))
    late = F.col("o_orderstatus") == "P"
    return joined.select(
        F.col("o_orderkey").alias("id"),
        "SAMPLE_POINT_NAME",
        "SITE_NAME",
        F.col("o_orderdate").alias("SAMPLE_DATE"),
        F.col("o_totalprice").alias("ENTEROCOCCI"),
        late.alias("RESAMPLE"),
        (~late & (F.col("o_orderpriority") == "5-LOW")).alias("OTHER"),
        F.year("o_orderdate").alias("YEAR"),
    )


def decorated_orders(spark: SparkSession, sf: str) -> DataFrame:
    return decorate(order_samples(spark, sf), limits=ORDER_LIMITS)


def calendar_orders(spark: SparkSession, sf: str) -> DataFrame:
    return add_calendar(decorated_orders(spark, sf))


NATIONS_SQL = """st AS (SELECT n_nationkey, n_name AS SAMPLE_POINT_NAME, r_name AS SITE_NAME,
  'Town of ' || n_name AS TOWN FROM nation JOIN region ON n_regionkey = r_regionkey)"""

ORDERS_SQL = (
    NATIONS_SQL
    + """, o0 AS (SELECT o_orderkey AS id, SAMPLE_POINT_NAME, SITE_NAME, o_orderdate AS SAMPLE_DATE,
  o_totalprice AS ENTEROCOCCI, o_orderstatus = 'P' AS RESAMPLE,
  o_orderstatus <> 'P' AND o_orderpriority = '5-LOW' AS OTHER,
  CAST(year(o_orderdate) AS INTEGER) AS YEAR
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN st ON c_nationkey = n_nationkey), """
    + _decorated_sql("o", "o0", 350000, 425000)
)

# --- raw measurements ---------------------------------------------------------


def _mapped(col: str, values: dict[str, str], prefix: str, suffix: str = "") -> Column:
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(F.col(col) == key, f"{prefix}{value}{suffix}").otherwise(out)
    return out


def _mapped_sql(col: str, values: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {col} {whens} END"


_WEATHER = {
    "1-URGENT": "CLEAR", "2-HIGH": "PARTLY CLOUDY", "3-MEDIUM": "OVERCAST",
    "4-NOT SPECIFIED": "RAIN", "5-LOW": "FOG",
}
_PAST_24 = {"F": "NO RAIN", "O": "LIGHT RAIN"}
_PAST_48 = {"F": "MEDIUM RAIN", "O": "HIGH RAIN", "P": "NO RAIN"}
_TIDE = {
    "AUTOMOBILE": "LOW", "BUILDING": "LOW FLOOD", "FURNITURE": "FLOOD",
    "HOUSEHOLD": "HIGH EBB", "MACHINERY": "SLACK",
}
_CURRENT = {"F": "SLOW", "O": "MEDIUM", "P": "RAPID"}
_SURFACE = {
    "AUTOMOBILE": "CALM", "BUILDING": "RIPPLED", "FURNITURE": "ROUGH",
    "HOUSEHOLD": "CALM", "MACHINERY": "ROUGH",
}


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Raw long measurements under their delivered header, derived from every order.

    Has samples with categorical data only, with numeric data only, and without a
    result; non-detects, unparseable values, padded names, an unlisted parameter.
    """
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    site = nations(spark, sf)
    joined = orders.join(
        customer.select("c_custkey", "c_nationkey", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
    ).join(site, F.col("c_nationkey") == F.col("n_nationkey"))
    # After the joins, whose shuffles would undo it.
    base = spread(joined.drop("o_custkey", "c_custkey", "n_nationkey"), orders.count())

    def part(divisor: int) -> Column:
        return F.floor(F.col("o_totalprice") / divisor).cast("bigint").cast("string")

    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    numeric = ~((status == "P") & (priority == "3-MEDIUM"))
    unparseable = (status == "P") & (priority == "4-NOT SPECIFIED")
    # Computed once per order, ahead of the generator, which keeps its code small.
    base = base.withColumns(
        {
            "is_num": numeric,
            "is_cat": ~((status == "O") & (priority == "2-HIGH")),
            "tested": numeric & ~((status == "F") & (priority == "1-URGENT")),
            "gauged": numeric & F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
            "result": F.when(unparseable, "<10").otherwise(part(4000)),
            "qualifier": F.when((status == "O") & (priority == "5-LOW"), NONDETECT_QUALIFIER),
            "air": part(20000),
            "water": part(30000),
            "salinity": F.concat(part(15000), F.lit(".5")),
            "rain_24": part(100000),
            "rain_48": F.concat(part(50000), F.lit(".25")),
            "rain_72": F.when(numeric & (priority == "2-HIGH"), part(50000)),
            "weather": _mapped("o_orderpriority", _WEATHER, "CURRENT WEATHER "),
            "past_24": _mapped("o_orderstatus", _PAST_24, "PAST 24HR WEATHER "),
            "past_48": _mapped("o_orderstatus", _PAST_48, "PAST 48HR WEATHER "),
            "tide": _mapped("c_mktsegment", _TIDE, "TIDE STAGE: "),
            "current": _mapped("o_orderstatus", _CURRENT, "WATER SURFACE ", " CURRENT"),
            "surface": _mapped("c_mktsegment", _SURFACE, "WATER SURFACE "),
            "depth": F.when(priority == "5-LOW", "SAMPLE DEPTH INTERVAL 0-1 FT"),
        }
    )

    def cell(when: str, kind: str, name: Column, value: str | None = None,
             note: str | None = None, limit: str | None = None) -> Column:
        return F.when(
            F.col(when),
            F.struct(
                F.lit(kind).alias("SAMPLE TYPE"),
                name.alias("PARAMETER NAME"),
                (F.col(value) if value else F.lit(None).cast("string")).alias("CONCENTRATION"),
                (F.col(note) if note else F.lit(None).cast("string")).alias(
                    "CONCENTRATION QUALIFIER"
                ),
                F.lit(limit).cast("string").alias("QUANITATION LIMIT"),
            ),
        )

    def measured(when: str, kind: str, name: str, value: str, *rest: str) -> Column:
        return cell(when, kind, F.lit(name), value, *rest)

    rows = F.array(
        measured("tested", "SURFACE WATER", "ENTEROCOCCI", "result", "qualifier", "10"),
        measured("is_num", "AIR", "TEMPERATURE", "air"),
        measured("is_num", "SURFACE WATER", "TEMPERATURE", "water"),
        measured("is_num", "SURFACE WATER", "SALINITY (FROM SODIUM)", "salinity"),
        measured("gauged", "GAUGE", "ACCUMULATION LAST 24 HOURS", "rain_24"),
        measured("is_num", "GAUGE", "ACCUMULATION LAST 48 HOURS", "rain_48"),
        cell("is_num", "GAUGE", F.when(F.col("rain_72").isNotNull(), "ACCUMULATION LAST 72 HOURS"), "rain_72"),
        *[
            cell("is_cat", "FIELD", F.col(c))
            for c in ("weather", "past_24", "past_48", "tide", "current", "surface", "depth")
        ],
    )
    key = F.col("c_nationkey")
    out = base.select(
        F.concat(key.cast("string"), F.lit(".0")).alias("SITE SEQUENCE NUMBER"),
        F.col("o_orderkey").cast("string").alias("SAMPLE SEQUENCE NUMBER"),
        "TOWN",
        F.concat(F.lit("\t "), "SITE_NAME", F.lit("  ")).alias("SITE NAME"),
        F.concat_ws("-", "SAMPLE_POINT_NAME", "c_mktsegment").alias("SAMPLE POINT NAME"),
        F.col("o_orderdate").alias("SAMPLE DATE"),
        F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("DEP SAMPLE ID"),
        (4770000 + key * 1000).cast("string").alias("SITE LATITUDE (UTM)"),
        (300000 + key * 3000).cast("string").alias("SITE LONGITUDE (UTM)"),
        F.lit("checked").alias("REMARKS"),
        F.inline(rows),
    )
    return out.filter(F.col("PARAMETER NAME").isNotNull())


_BASE_SQL = """b AS (SELECT *, NOT (o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM') AS is_num,
  NOT (o_orderstatus = 'O' AND o_orderpriority = '2-HIGH') AS is_cat
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN st ON c_nationkey = n_nationkey)"""


def _part_sql(divisor: int) -> str:
    return f"CAST(CAST(floor(o_totalprice / {divisor}) AS BIGINT) AS VARCHAR)"


def _row_sql(when: str, kind: str, name: str, value: str = "NULL", note: str = "NULL",
             limit: str = "NULL") -> str:
    return f"""SELECT c_nationkey, o_orderkey, TOWN, SITE_NAME, SAMPLE_POINT_NAME || '-' || c_mktsegment AS pt,
  o_orderdate, '{kind}' AS kind, {name} AS pname, CAST({value} AS VARCHAR) AS conc,
  CAST({note} AS VARCHAR) AS qual, CAST({limit} AS VARCHAR) AS lim
  FROM b WHERE {when} AND {name} IS NOT NULL"""


RAW_SQL = ", ".join(
    [
        NATIONS_SQL,
        _BASE_SQL,
        "p AS ("
        + " UNION ALL ".join(
            [
                _row_sql(
                    "is_num AND NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')",
                    "SURFACE WATER", "'ENTEROCOCCI'",
                    "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' "
                    f"THEN '<10' ELSE {_part_sql(4000)} END",
                    "CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' "
                    f"THEN '{NONDETECT_QUALIFIER}' END",
                    "'10'",
                ),
                _row_sql("is_num", "AIR", "'TEMPERATURE'", _part_sql(20000)),
                _row_sql("is_num", "SURFACE WATER", "'TEMPERATURE'", _part_sql(30000)),
                _row_sql(
                    "is_num", "SURFACE WATER", "'SALINITY (FROM SODIUM)'",
                    f"{_part_sql(15000)} || '.5'",
                ),
                _row_sql(
                    "is_num AND c_mktsegment IN ('BUILDING', 'MACHINERY')", "GAUGE",
                    "'ACCUMULATION LAST 24 HOURS'", _part_sql(100000),
                ),
                _row_sql(
                    "is_num", "GAUGE", "'ACCUMULATION LAST 48 HOURS'",
                    f"{_part_sql(50000)} || '.25'",
                ),
                _row_sql(
                    "is_num AND o_orderpriority = '2-HIGH'", "GAUGE",
                    "'ACCUMULATION LAST 72 HOURS'", _part_sql(50000),
                ),
                _row_sql("is_cat", "FIELD", f"'CURRENT WEATHER ' || {_mapped_sql('o_orderpriority', _WEATHER)}"),
                _row_sql("is_cat", "FIELD", f"'PAST 24HR WEATHER ' || {_mapped_sql('o_orderstatus', _PAST_24)}"),
                _row_sql("is_cat", "FIELD", f"'PAST 48HR WEATHER ' || {_mapped_sql('o_orderstatus', _PAST_48)}"),
                _row_sql("is_cat", "FIELD", f"'TIDE STAGE: ' || {_mapped_sql('c_mktsegment', _TIDE)}"),
                _row_sql("is_cat", "FIELD", f"'WATER SURFACE ' || {_mapped_sql('o_orderstatus', _CURRENT)} || ' CURRENT'"),
                _row_sql("is_cat", "FIELD", f"'WATER SURFACE ' || {_mapped_sql('c_mktsegment', _SURFACE)}"),
                _row_sql(
                    "is_cat AND o_orderpriority = '5-LOW'", "FIELD",
                    "'SAMPLE DEPTH INTERVAL 0-1 FT'",
                ),
            ]
        )
        + ")",
        """c AS (SELECT CAST(c_nationkey AS INTEGER) AS SITE_SEQUENCE_NUMBER,
  CAST(o_orderkey AS INTEGER) AS SAMPLE_SEQUENCE_NUMBER, TOWN, SITE_NAME,
  pt AS SAMPLE_POINT_NAME, o_orderdate AS SAMPLE_DATE, 'D' || o_orderkey AS DEP_SAMPLE_ID,
  CAST(4770000 + c_nationkey * 1000 AS DOUBLE) AS SITE_LATITUDE_UTM,
  CAST(300000 + c_nationkey * 3000 AS DOUBLE) AS SITE_LONGITUDE_UTM, kind AS SAMPLE_TYPE,
  pname AS PARAMETER_NAME, conc AS CONCENTRATION, qual AS CONCENTRATION_QUALIFIER,
  CAST(lim AS DOUBLE) AS QUANITATION_LIMIT FROM p)""",
    ]
)

KEYS_SQL = "SAMPLE_POINT_NAME, DEP_SAMPLE_ID, SAMPLE_DATE"

CATEGORIES_SQL = f"""cat AS (
  SELECT {KEYS_SQL}, 'CURRENT_WEATHER' AS PARAMETER_NAME, replace(PARAMETER_NAME, 'CURRENT WEATHER ', '') AS VALUE FROM c WHERE PARAMETER_NAME LIKE '%CURRENT WEATHER%'
  UNION ALL SELECT {KEYS_SQL}, 'PAST_WEATHER_24HR', replace(PARAMETER_NAME, 'PAST 24HR WEATHER ', '') FROM c WHERE PARAMETER_NAME LIKE '%PAST 24HR WEATHER%'
  UNION ALL SELECT {KEYS_SQL}, 'PAST_WEATHER_48HR', replace(PARAMETER_NAME, 'PAST 48HR WEATHER ', '') FROM c WHERE PARAMETER_NAME LIKE '%PAST 48HR WEATHER%'
  UNION ALL SELECT {KEYS_SQL}, 'TIDE', replace(PARAMETER_NAME, 'TIDE STAGE: ', '') FROM c WHERE PARAMETER_NAME LIKE '%TIDE STAGE%'
  UNION ALL SELECT {KEYS_SQL}, 'CURRENT', replace(PARAMETER_NAME, 'WATER SURFACE ', '') FROM c WHERE PARAMETER_NAME LIKE '%WATER SURFACE%' AND PARAMETER_NAME LIKE '%CURRENT'
  UNION ALL SELECT {KEYS_SQL}, 'WATER_SURFACE', replace(PARAMETER_NAME, 'WATER SURFACE ', '') FROM c WHERE PARAMETER_NAME LIKE '%WATER SURFACE%' AND PARAMETER_NAME NOT LIKE '%CURRENT')"""

NUMERIC_SQL = f"""num AS (
  SELECT {KEYS_SQL}, CASE PARAMETER_NAME WHEN 'ACCUMULATION LAST 48 HOURS' THEN 'ACCUMULATION_48HR' WHEN 'ACCUMULATION LAST 24 HOURS' THEN 'ACCUMULATION_24HR' ELSE PARAMETER_NAME END AS PARAMETER_NAME, TRY_CAST(CONCENTRATION AS DOUBLE) AS VALUE FROM c WHERE PARAMETER_NAME LIKE '%ACCUMULATION%'
  UNION ALL SELECT {KEYS_SQL}, 'TEMP_AIR', TRY_CAST(CONCENTRATION AS DOUBLE) FROM c WHERE SAMPLE_TYPE = 'AIR'
  UNION ALL SELECT {KEYS_SQL}, CASE PARAMETER_NAME WHEN 'TEMPERATURE' THEN 'TEMP_WATER' ELSE 'SALINITY' END, TRY_CAST(CONCENTRATION AS DOUBLE) FROM c WHERE SAMPLE_TYPE = 'SURFACE WATER' AND PARAMETER_NAME IN ('TEMPERATURE', 'SALINITY (FROM SODIUM)')
  UNION ALL SELECT {KEYS_SQL}, 'ENTEROCOCCI', CASE WHEN CONCENTRATION_QUALIFIER = '{NONDETECT_QUALIFIER}' THEN QUANITATION_LIMIT ELSE TRY_CAST(CONCENTRATION AS DOUBLE) END FROM c WHERE PARAMETER_NAME = 'ENTEROCOCCI')"""

_CATS = ["CURRENT", "CURRENT_WEATHER", "PAST_WEATHER_24HR", "PAST_WEATHER_48HR", "TIDE", "WATER_SURFACE"]
_NUMS = ["ACCUMULATION_24HR", "ACCUMULATION_48HR", "ENTEROCOCCI", "SALINITY", "TEMP_AIR", "TEMP_WATER"]


def _pivot_sql(name: str, source: str, names: list[str]) -> str:
    cells = ", ".join(f"max(CASE WHEN PARAMETER_NAME = '{n}' THEN VALUE END) AS {n}" for n in names)
    return f"""{name} AS (SELECT {KEYS_SQL}, {cells} FROM {source} GROUP BY ALL)"""


WIDE_CAT_SQL = _pivot_sql("wcat", "cat", _CATS)
WIDE_NUM_SQL = _pivot_sql("wnum", "num", _NUMS)

WIDE_SQL = ", ".join(
    [
        RAW_SQL,
        CATEGORIES_SQL,
        NUMERIC_SQL,
        WIDE_CAT_SQL,
        WIDE_NUM_SQL,
        f"""w0 AS (SELECT {', '.join(f'coalesce(wcat.{k}, wnum.{k}) AS {k}' for k in KEYS_SQL.split(', '))},
  {', '.join(_CATS)}, {', '.join(_NUMS)}, wcat.SAMPLE_POINT_NAME IS NULL AS NUMERIC_ONLY
  FROM wcat FULL OUTER JOIN wnum ON {' AND '.join(f'wcat.{k} IS NOT DISTINCT FROM wnum.{k}' for k in KEYS_SQL.split(', '))})""",
        """w AS (SELECT *, (NOT NUMERIC_ONLY AND CURRENT_WEATHER = 'FOG') AS OTHER,
  (NOT NUMERIC_ONLY AND CURRENT = 'RAPID CURRENT') AS RESAMPLE,
  CAST(year(SAMPLE_DATE) AS INTEGER) AS YEAR,
  coalesce(ACCUMULATION_24HR * 2, ACCUMULATION_48HR) AS ACCUMULATION,
  coalesce(PAST_WEATHER_24HR, PAST_WEATHER_48HR) AS PAST_WEATHER
  FROM w0 WHERE ENTEROCOCCI IS NOT NULL)""",
    ]
)


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return typed_rows(raw_rows(spark, sf))


def clean_rows(spark: SparkSession, sf: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct typed rows; with ``by``, dealt by these columns, as one, as in ``dedup_rows``.

    A task then holds half as many orders as one that makes rows, as it hashes whole rows and may
    do more with them in place.
    """
    tasks = tasks_for(spark, 2 * table(spark, sf, "orders").count()) if by else None
    return standardise(raw_rows(spark, sf), by=by, tasks=tasks)


def wide_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Wide samples with a result and with the covariates, without ids."""
    wide = with_result(widen(typed(spark, sf)))
    return wide.withColumn("YEAR", F.year("SAMPLE_DATE"))


def supplier_points(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as station rows: one point (nation) has many coordinates."""
    supplier = table(spark, sf, "supplier")
    return supplier.join(nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("int").alias("SITE_SEQUENCE_NUMBER"),
        "TOWN",
        "SITE_NAME",
        "SAMPLE_POINT_NAME",
        (F.lit(4770000.0) + F.col("s_suppkey") * 1000).alias("SITE_LATITUDE_UTM"),
        (F.lit(300000.0) + F.col("s_suppkey") * 300).alias("SITE_LONGITUDE_UTM"),
    )


SUPPLIER_SQL = (
    NATIONS_SQL
    + """, sp AS (SELECT CAST(s_suppkey AS INTEGER) AS SITE_SEQUENCE_NUMBER, TOWN, SITE_NAME,
  SAMPLE_POINT_NAME, 4770000e0 + s_suppkey * 1000 AS SITE_LATITUDE_UTM,
  300000e0 + s_suppkey * 300 AS SITE_LONGITUDE_UTM
  FROM supplier JOIN st ON s_nationkey = n_nationkey)"""
)
