"""A, W, H: exceedance tables, persistence, distributions, explorer tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.classify import add_sample_type, as_ordered, harmonise
from strandline.model import (
    CATEGORICAL_NAMES,
    NUMERIC_NAMES,
    TIDE_LEVELS,
    Limits,
)
from strandline.operators.groups import with_group_count
from strandline.operators.previous import with_previous
from strandline.operators.ranking import rank_by
from strandline.operators.reshape import unpivot
from strandline.plans import distribution as dist
from strandline.plans import exceedance as ex
from strandline.plans import explore as xp
from strandline.plans import persistence as ps
from strandline.plans.assembly import widen
from strandline.plans.stations import station_stats_dim
from strandline.queries import bindings as b
from strandline.queries.registry import query, rounded

E, O = b.EVENTS_SQL, b.ORDERS_SQL
SITE = "SAMPLE_POINT_NAME"

# Interval classes: zero or less has none.
BINNED = (
    "CASE WHEN ENTEROCOCCI > 104 THEN '>104' WHEN ENTEROCOCCI > 70 THEN '70-104' "
    "WHEN ENTEROCOCCI > 0 THEN '<70' END"
)


def _r(expr: str) -> str:
    return f"round({expr}, 6)"


# --- coverage ---------------------------------------------------------------------------


def _coverage_sql(names) -> str:
    return f"""WITH {b.WIDE_SQL}, u AS (UNPIVOT (SELECT SAMPLE_DATE, {', '.join(names)} FROM w0)
  ON {', '.join(names)} INTO NAME PARAMETER_NAME VALUE VALUE)
  SELECT PARAMETER_NAME, CAST(year(SAMPLE_DATE) AS INTEGER) AS YEAR, count(*) AS n FROM u GROUP BY ALL"""


@query("a1_coverage_categorical", _coverage_sql(CATEGORICAL_NAMES))
def _(spark, sf):
    return ex.coverage_by_variable(widen(b.typed(spark, sf)), CATEGORICAL_NAMES)


@query("a1_coverage_numeric", _coverage_sql(NUMERIC_NAMES))
def _(spark, sf):
    return ex.coverage_by_variable(widen(b.typed(spark, sf)), NUMERIC_NAMES)


@query("a2_coverage_by_site", f"WITH {O} SELECT SAMPLE_POINT_NAME, YEAR, count(*) AS n FROM o GROUP BY ALL")
def _(spark, sf):
    return ex.coverage_by_site(b.order_samples(spark, sf))


@query(
    "a3_type_frequency",
    f"""WITH {E} SELECT t.SAMPLE_TYPE, count(e.id) AS n
  FROM (VALUES ('Routine'), ('Resample'), ('Irregular'), ('Special')) t(SAMPLE_TYPE)
  LEFT JOIN e ON e.SAMPLE_TYPE = t.SAMPLE_TYPE GROUP BY ALL""",
)
def _(spark, sf):
    typed = add_sample_type(b.event_samples(spark, sf))
    return ex.type_frequency(typed, ("Routine", "Resample", "Irregular", "Special"))


# --- the lower limit by site and year -----------------------------------------------------

A4_SQL = """a4 AS (SELECT SAMPLE_POINT_NAME, YEAR, count(*) AS N,
  CAST(sum(GT_104) AS BIGINT) AS N_GT_104, CAST(sum(GT_70) AS BIGINT) AS N_GT_70,
  CAST(sum(GT_70 * (1 - GT_104)) AS BIGINT) AS N_BW_70_104,
  sum(GT_70 * (1 - GT_104)) / count(*) AS F FROM o WHERE routine GROUP BY ALL)"""
A4_COLUMNS = f"SAMPLE_POINT_NAME, YEAR, N, N_GT_104, N_GT_70, N_BW_70_104, {_r('F')} AS FRAC_BW_70_104"

A6_SQL = """a6 AS (SELECT SAMPLE_POINT_NAME, min(F) AS MIN_FRAC_BW_70_104, max(F) AS MAX_FRAC_BW_70_104,
  avg(F) AS MEAN_FRAC_BW_70_104, quantile_cont(F, 0.5) AS MEDIAN_FRAC_BW_70_104, count(*) AS N_YEAR,
  CAST(sum(N) AS BIGINT) AS N_SAMPLE, avg(N) AS MEAN_N_SAMPLE_PER_YEAR,
  CAST(quantile_cont(N, 0.5) AS DOUBLE) AS MEDIAN_N_SAMPLE_PER_YEAR,
  avg(F) * avg(N) AS MEAN_N_RESAMPLE_PER_YEAR,
  quantile_cont(F, 0.5) * quantile_cont(N, 0.5) AS MEDIAN_N_RESAMPLE_PER_YEAR,
  max(F) * avg(N) AS MAX_N_RESAMPLE_PER_YEAR FROM a4 GROUP BY SAMPLE_POINT_NAME)"""
A6_NAMES = (
    "MIN_FRAC_BW_70_104 MAX_FRAC_BW_70_104 MEAN_FRAC_BW_70_104 MEDIAN_FRAC_BW_70_104 "
    "MEAN_N_SAMPLE_PER_YEAR MEDIAN_N_SAMPLE_PER_YEAR MEAN_N_RESAMPLE_PER_YEAR "
    "MEDIAN_N_RESAMPLE_PER_YEAR MAX_N_RESAMPLE_PER_YEAR"
).split()
A6_COLUMNS = "SAMPLE_POINT_NAME, N_YEAR, N_SAMPLE, " + ", ".join(f"{_r(c)} AS {c}" for c in A6_NAMES)


def _a4(spark, sf):
    return ex.low_limit_by_site_year(b.order_samples(spark, sf), limits=b.ORDER_LIMITS)


@query("a4_low_limit_by_site_year", f"WITH {O}, {A4_SQL} SELECT {A4_COLUMNS} FROM a4")
def _(spark, sf):
    return rounded(_a4(spark, sf))


@query("a5_ranked_by_fraction", f"WITH {O}, {A4_SQL} SELECT {A4_COLUMNS} FROM a4 ORDER BY F DESC")
def _(spark, sf):
    return rounded(rank_by(_a4(spark, sf), "FRAC_BW_70_104", [SITE, "YEAR"]))


@query("a6_low_limit_by_site", f"WITH {O}, {A4_SQL}, {A6_SQL} SELECT {A6_COLUMNS} FROM a6")
def _(spark, sf):
    return rounded(ex.low_limit_by_site(_a4(spark, sf)))


@query(
    "a7_ranked_by_extra_resamples",
    f"""WITH {O}, {A4_SQL}, {A6_SQL} SELECT {A6_COLUMNS} FROM a6
  ORDER BY a6.MEDIAN_N_RESAMPLE_PER_YEAR DESC, SAMPLE_POINT_NAME""",
)
def _(spark, sf):
    by_site = ex.low_limit_by_site(_a4(spark, sf))
    return rounded(rank_by(by_site, "MEDIAN_N_RESAMPLE_PER_YEAR", [SITE]))


@query(
    "a8_programme_totals",
    f"WITH {O}, {A4_SQL}, {A6_SQL} SELECT "
    + ", ".join(
        f"{_r(f'sum({c})')} AS {c}"
        for c in (
            "MEDIAN_N_SAMPLE_PER_YEAR", "MEAN_N_SAMPLE_PER_YEAR",
            "MEDIAN_N_RESAMPLE_PER_YEAR", "MEAN_N_RESAMPLE_PER_YEAR",
        )
    )
    + " FROM a6",
)
def _(spark, sf):
    return rounded(ex.programme_totals(ex.low_limit_by_site(_a4(spark, sf))))


# --- classes by site and year ---------------------------------------------------------------

A9_SQL = """a9 AS (SELECT *, N - N_104 - N_70 AS N_CLEAN FROM (SELECT SITE_NAME, SAMPLE_POINT_NAME, YEAR, count(*) AS N,
  CAST(sum(GT_104) AS BIGINT) AS N_104, CAST(sum(GT_70) - sum(GT_104) AS BIGINT) AS N_70
  FROM o WHERE routine GROUP BY ALL))"""


def _a9(spark, sf):
    return ex.class_counts_by_site_year(b.order_samples(spark, sf), limits=b.ORDER_LIMITS)


@query(
    "a9_site_year_classes",
    f"""WITH {O}, {A9_SQL} SELECT SITE_NAME, SAMPLE_POINT_NAME, YEAR, N, N_104, N_70, N_CLEAN,
  {_r('N_104 / N')} AS F_104, {_r('N_70 / N')} AS F_70, {_r('N_CLEAN / N')} AS F_CLEAN FROM a9""",
)
def _(spark, sf):
    return rounded(_a9(spark, sf))


@query(
    "a9_site_month_events",
    f"""WITH {E} SELECT 'all' AS SITE_NAME, SAMPLE_POINT_NAME, YEAR, count(*) AS N,
  CAST(sum(GT_104) AS BIGINT) AS N_104, CAST(sum(GT_70) - sum(GT_104) AS BIGINT) AS N_70,
  CAST(count(*) - sum(GT_70) AS BIGINT) AS N_CLEAN, {_r('avg(GT_104)')} AS F_104,
  {_r('avg(GT_70 - GT_104)')} AS F_70, {_r('avg(1 - GT_70)')} AS F_CLEAN FROM e WHERE routine GROUP BY ALL""",
)
def _(spark, sf):
    samples = b.event_samples(spark, sf).withColumn("SITE_NAME", F.lit("all"))
    return rounded(ex.class_counts_by_site_year(samples))


def _a10_sql(direction: str) -> str:
    return f"""WITH {O}, {A9_SQL}, m AS (SELECT SAMPLE_POINT_NAME, avg(N_104) AS MEAN_N_104, avg(N_70) AS MEAN_N_70
  FROM a9 GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY MEAN_N_104 + MEAN_N_70 {direction}, SAMPLE_POINT_NAME) AS level_rank FROM m)
  SELECT SAMPLE_POINT_NAME, level_rank, 'MEAN_N_104' AS VARIABLE, {_r('MEAN_N_104')} AS VALUE FROM k
  UNION ALL SELECT SAMPLE_POINT_NAME, level_rank, 'MEAN_N_70', {_r('MEAN_N_70')} FROM k"""


@query("a10_mean_exceedances", _a10_sql("ASC"))
def _(spark, sf):
    return rounded(ex.mean_exceedances_by_site(_a9(spark, sf)))


@query("a10_mean_exceedances_desc", _a10_sql("DESC"))
def _(spark, sf):
    return rounded(ex.mean_exceedances_by_site(_a9(spark, sf), desc=True))


@query(
    "a11_mean_extra_by_site",
    f"WITH {O}, {A9_SQL} SELECT SAMPLE_POINT_NAME, {_r('avg(N_70)')} AS MEAN_N_70 FROM a9 GROUP BY ALL",
)
def _(spark, sf):
    return rounded(ex.mean_extra_by_site(_a9(spark, sf)))


@query(
    "a12_extra_by_year",
    f"WITH {O}, {A9_SQL} SELECT YEAR, CAST(sum(N_70) AS BIGINT) AS SUM_N_70 FROM a9 GROUP BY ALL",
)
def _(spark, sf):
    return ex.extra_by_year(_a9(spark, sf))


@query(
    "a13_mean_extra_total",
    f"""WITH {O}, {A9_SQL}, m AS (SELECT avg(N_70) AS m FROM a9 GROUP BY SAMPLE_POINT_NAME)
  SELECT {_r('sum(m)')} AS SUM FROM m""",
)
def _(spark, sf):
    return rounded(ex.mean_extra_total(_a9(spark, sf)))


A14_SQL = """u14 AS (SELECT SAMPLE_POINT_NAME, N, 'N_CLEAN' AS VAR, N_CLEAN AS V FROM a9
  UNION ALL SELECT SAMPLE_POINT_NAME, N, 'N_70', N_70 FROM a9 UNION ALL SELECT SAMPLE_POINT_NAME, N, 'N_104', N_104 FROM a9),
  a14 AS (SELECT SAMPLE_POINT_NAME, VAR, CAST(sum(N) AS BIGINT) AS N, avg(V) AS MEAN_VALUE, avg(V / N) AS MEAN_FRAC
  FROM u14 GROUP BY SAMPLE_POINT_NAME, VAR)"""


@query(
    "a14_class_means_by_site",
    f"""WITH {O}, {A9_SQL}, {A14_SQL} SELECT SAMPLE_POINT_NAME, VAR, N, {_r('MEAN_VALUE')} AS MEAN_VALUE,
  {_r('MEAN_FRAC')} AS MEAN_FRAC FROM a14""",
)
def _(spark, sf):
    return rounded(ex.class_means_by_site(_a9(spark, sf)))


A15_SQL = """a15 AS (SELECT SAMPLE_POINT_NAME, count(*) AS COUNT, avg(CAST(ENTEROCOCCI > 104 AS INTEGER)) AS FRAC_GT_SSM,
  avg(CAST(ENTEROCOCCI > 70 AS INTEGER)) AS FRAC_GT_BAV,
  avg(CAST(ENTEROCOCCI > 70 AND ENTEROCOCCI < 104 AS INTEGER)) AS FRAC_BAV_SSM,
  quantile_cont(ENTEROCOCCI, 0.5) AS MEDIAN,
  CASE WHEN min(ENTEROCOCCI) < 0 THEN NULL WHEN min(ENTEROCOCCI) = 0 THEN 0
  ELSE exp(avg(ln(CASE WHEN ENTEROCOCCI > 0 THEN ENTEROCOCCI END))) END AS GEOMEAN FROM {source} GROUP BY SAMPLE_POINT_NAME)"""
A15_COLUMNS = "SAMPLE_POINT_NAME, COUNT, " + ", ".join(
    f"{_r(c)} AS {c}" for c in ("FRAC_GT_SSM", "FRAC_GT_BAV", "FRAC_BAV_SSM", "MEDIAN", "GEOMEAN")
)


@query("a15_site_statistics", f"WITH {E}, {A15_SQL.format(source='e')} SELECT {A15_COLUMNS} FROM a15")
def _(spark, sf):
    return rounded(ex.site_statistics(b.event_samples(spark, sf)))


@query(
    "a15_site_statistics_assembled",
    f"WITH {b.WIDE_SQL}, {A15_SQL.format(source='w')} SELECT {A15_COLUMNS} FROM a15",
)
def _(spark, sf):
    return rounded(ex.site_statistics(b.wide_samples(spark, sf)))


# --- class shares -----------------------------------------------------------------------------


@query(
    "a16_class_proportions",
    f"""WITH {E} SELECT CLASS, {_r('count(*) / (SELECT count(*) FROM e WHERE routine)')} AS FREQ
  FROM e WHERE routine GROUP BY CLASS""",
)
def _(spark, sf):
    routine = b.decorated_events(spark, sf).filter("SAMPLE_TYPE = 'Routine'")
    return rounded(dist.class_proportions(routine))


@query(
    "a17_conditional_proportions",
    f"""WITH {E} SELECT CLASS, {_r('count(*) / (SELECT count(*) FROM e WHERE routine AND GT_70 = 1)')} AS FREQ
  FROM e WHERE routine AND GT_70 = 1 GROUP BY CLASS""",
)
def _(spark, sf):
    routine = b.decorated_events(spark, sf).filter("SAMPLE_TYPE = 'Routine'")
    return rounded(dist.class_proportions_above(routine, 70.0))


def _filled_sql(group: str) -> str:
    return f"""g AS (SELECT {group}, count(*) AS N_GROUP FROM o WHERE routine GROUP BY ALL),
  lv AS (SELECT unnest(['<=70', '70-104', '>104']) AS CLASS),
  k AS (SELECT {group}, CLASS, count(*) AS N FROM o WHERE routine GROUP BY ALL),
  filled AS (SELECT g.{group}, lv.CLASS, coalesce(k.N, 0) AS N, N_GROUP, coalesce(k.N, 0) / N_GROUP AS FRAC
    FROM g CROSS JOIN lv LEFT JOIN k ON k.{group} = g.{group} AND k.CLASS = lv.CLASS)"""


def _routine_orders(spark, sf):
    return b.decorated_orders(spark, sf).filter("SAMPLE_TYPE = 'Routine'")


for _group, _slug in (("SITE_NAME", "beach"), ("SAMPLE_POINT_NAME", "site")):

    @query(
        f"a18_class_counts_by_{_slug}",
        f"""WITH {O}, {_filled_sql(_group)}, rk AS (SELECT {_group}, row_number() OVER (ORDER BY N_GROUP, {_group}) AS group_rank FROM g)
  SELECT {_group}, N_GROUP, group_rank, CLASS, N, {_r('N / (SELECT sum(N_GROUP) FROM g)')} AS FRAC FROM filled JOIN rk USING ({_group})""",
    )
    def _(spark, sf, group=_group):
        return rounded(dist.class_counts_filled(_routine_orders(spark, sf), group))

    @query(
        f"a19_class_shares_by_{_slug}",
        f"""WITH {O}, {_filled_sql(_group)}, rk AS (SELECT {_group}, row_number() OVER (ORDER BY FRAC, {_group}) AS group_rank FROM filled WHERE CLASS = '>104')
  SELECT {_group}, group_rank, CLASS, {_r('FRAC')} AS FRAC FROM filled JOIN rk USING ({_group})""",
    )
    def _(spark, sf, group=_group):
        return rounded(dist.class_shares_filled(_routine_orders(spark, sf), group))

    @query(
        f"a20_share_between_limits_by_{_slug}",
        f"""WITH {O}, {_filled_sql(_group)} SELECT {_group}, CLASS, {_r('FRAC')} AS FRAC,
  row_number() OVER (ORDER BY FRAC, {_group}) AS group_rank FROM filled WHERE CLASS = '70-104'""",
    )
    def _(spark, sf, group=_group):
        return rounded(dist.class_share_of(_routine_orders(spark, sf), group))

    @query(
        f"w8_share_cdf_by_{_slug}",
        f"""WITH {O}, {_filled_sql(_group)}, s AS (SELECT {_group}, CLASS, N, FRAC FROM filled WHERE N > 0)
  SELECT {_group}, CLASS, N, {_r('FRAC')} AS FRAC,
  {_r(f'row_number() OVER (PARTITION BY CLASS ORDER BY FRAC, {_group}) / count(*) OVER (PARTITION BY CLASS)')} AS INDEX FROM s""",
    )
    def _(spark, sf, group=_group):
        return rounded(dist.share_cdf(_routine_orders(spark, sf), group))


# Many small groups: some lack a class, and shares tie often.
@query(
    "w8_share_cdf_by_user",
    f"""WITH {E}, k AS (SELECT SAMPLE_POINT_NAME, CLASS, count(*) AS N FROM e WHERE routine GROUP BY ALL),
  s AS (SELECT *, N / sum(N) OVER (PARTITION BY SAMPLE_POINT_NAME) AS FRAC FROM k)
  SELECT SAMPLE_POINT_NAME, CLASS, N, {_r('FRAC')} AS FRAC,
  {_r('row_number() OVER (PARTITION BY CLASS ORDER BY FRAC, SAMPLE_POINT_NAME) / count(*) OVER (PARTITION BY CLASS)')} AS INDEX FROM s""",
)
def _(spark, sf):
    routine = b.decorated_events(spark, sf).filter("SAMPLE_TYPE = 'Routine'")
    return rounded(dist.share_cdf(routine, SITE))


def _rank_curve_sql(where: str) -> str:
    return f"""WITH {O}, {A9_SQL}, {A14_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY VAR ORDER BY MEAN_FRAC, SAMPLE_POINT_NAME) AS RANK,
  count(*) OVER (PARTITION BY VAR) AS c FROM a14 {where})
  SELECT SAMPLE_POINT_NAME, VAR, {_r('MEAN_FRAC')} AS MEAN_FRAC, RANK, {_r('RANK / c')} AS FREQ,
  {_r('1 - RANK / c')} AS COMPLEMENT FROM k"""


@query("w9_rank_curve", _rank_curve_sql(""))
def _(spark, sf):
    return rounded(dist.rank_curve(ex.class_means_by_site(_a9(spark, sf))))


@query("w9_rank_curve_exceeding", _rank_curve_sql("WHERE VAR <> 'N_CLEAN'"))
def _(spark, sf):
    means = ex.class_means_by_site(_a9(spark, sf))
    return rounded(dist.rank_curve(means, drop=["N_CLEAN"]))


# --- persistence ----------------------------------------------------------------------------------


@query(
    "w2_previous_flag",
    f"""WITH {O} SELECT id, SAMPLE_POINT_NAME, GT_104,
  lag(GT_104) OVER (PARTITION BY SAMPLE_POINT_NAME ORDER BY SAMPLE_DATE, id) AS PREV_GT_104 FROM o""",
)
def _(spark, sf):
    previous = with_previous(
        b.decorated_orders(spark, sf).select("id", SITE, "SAMPLE_DATE", "GT_104"), [SITE], ["GT_104"]
    )
    return previous.select("id", SITE, "GT_104", "PREV_GT_104")


def _w3_sql(source: str) -> str:
    over = "OVER (PARTITION BY SAMPLE_POINT_NAME, YEAR ORDER BY SAMPLE_DATE, id)"
    return f"""w3 AS (SELECT *, lag(GT_104) {over} AS PREV_GT_104, lag(ENTEROCOCCI) {over} AS PREV_ENTEROCOCCI,
  lag(CLASS) {over} AS PREV_CLASS, lag(RESAMPLE) {over} AS PREV_RESAMPLE,
  CAST(date_diff('day', CAST(lag(SAMPLE_DATE) {over} AS DATE), CAST(SAMPLE_DATE AS DATE)) AS INTEGER) AS DIFFTIME FROM {source})"""


W3_SQL = f"{O}, {_w3_sql('o')}"


def _w3(spark, sf):
    return ps.with_previous_sample(b.decorated_orders(spark, sf))


W3_COLUMNS = f"""id, SAMPLE_POINT_NAME, YEAR, RESAMPLE, {_r('ENTEROCOCCI')} AS ENTEROCOCCI, PREV_GT_104,
  {_r('PREV_ENTEROCOCCI')} AS PREV_ENTEROCOCCI, PREV_CLASS, DIFFTIME"""
W3_NAMES = ["id", SITE, "YEAR", "RESAMPLE", "ENTEROCOCCI", "PREV_GT_104", "PREV_ENTEROCOCCI", "PREV_CLASS", "DIFFTIME"]


@query("w3_previous_sample", f"WITH {W3_SQL} SELECT {W3_COLUMNS} FROM w3")
def _(spark, sf):
    return rounded(_w3(spark, sf).select(*W3_NAMES))


@query("w3_previous_sample_events", f"WITH {E}, {_w3_sql('e')} SELECT {W3_COLUMNS} FROM w3")
def _(spark, sf):
    previous = ps.with_previous_sample(b.decorated_events(spark, sf))
    return rounded(previous.select(*W3_NAMES))


W4_WHERE = "RESAMPLE AND PREV_ENTEROCOCCI > 425000 AND DIFFTIME <= 3"


@query("w4_followups", f"WITH {W3_SQL} SELECT {W3_COLUMNS} FROM w3 WHERE {W4_WHERE}")
def _(spark, sf):
    return rounded(ps.followups(_w3(spark, sf), limits=b.ORDER_LIMITS).select(*W3_NAMES))


def _initial(spark, sf):
    return ps.followups(_w3(spark, sf), limits=b.ORDER_LIMITS, initial_only=True)


@query(
    "w4_initial_followups",
    f"WITH {W3_SQL} SELECT {W3_COLUMNS} FROM w3 WHERE {W4_WHERE} AND NOT PREV_RESAMPLE",
)
def _(spark, sf):
    return rounded(_initial(spark, sf).select(*W3_NAMES))


@query(
    "a21_repeat_exceedance_by_site",
    f"""WITH {W3_SQL} SELECT SAMPLE_POINT_NAME, count(*) AS N, CAST(sum(GT_104) AS BIGINT) AS N_GT_104,
  {_r('sum(GT_104) / count(*)')} AS FRAC FROM w3 WHERE RESAMPLE AND DIFFTIME IN (1, 2) GROUP BY ALL HAVING count(*) > 10""",
)
def _(spark, sf):
    return rounded(ps.repeat_exceedance_by_site(_w3(spark, sf)))


@query(
    "a22_initial_resample_total",
    f"""WITH {W3_SQL} SELECT count(*) AS N_TOTAL, CAST(sum(GT_104) AS BIGINT) AS N_EXCEED,
  {_r('sum(GT_104) / count(*)')} AS FRAC FROM w3 WHERE {W4_WHERE} AND NOT PREV_RESAMPLE""",
)
def _(spark, sf):
    return rounded(ps.initial_resample_total(_initial(spark, sf)))


@query(
    "a23_initial_resample_by_site",
    f"""WITH {W3_SQL} SELECT SAMPLE_POINT_NAME, count(*) AS N_TOTAL, CAST(sum(GT_104) AS BIGINT) AS N_EXCEED,
  {_r('sum(GT_104) / count(*)')} AS FRAC FROM w3 WHERE {W4_WHERE} AND NOT PREV_RESAMPLE
  GROUP BY ALL HAVING count(*) > 10""",
)
def _(spark, sf):
    return rounded(ps.initial_resample_by_site(_initial(spark, sf)))


@query(
    "h10_followup_pairs",
    f"""WITH {W3_SQL} SELECT SAMPLE_POINT_NAME, {_r('PREV_ENTEROCOCCI')} AS PREV, {_r('ENTEROCOCCI')} AS ENTEROCOCCI,
  CLASS, DIFFTIME FROM w3 WHERE {W4_WHERE}""",
)
def _(spark, sf):
    pairs = ps.followups(_w3(spark, sf), limits=b.ORDER_LIMITS)
    return rounded(ps.followup_pairs(pairs))


@query(
    "h10_resample_pairs_by_gap",
    f"""WITH {W3_SQL} SELECT SAMPLE_POINT_NAME, {_r('PREV_ENTEROCOCCI')} AS PREV, {_r('ENTEROCOCCI')} AS ENTEROCOCCI,
  CLASS, DIFFTIME FROM w3 WHERE RESAMPLE""",
)
def _(spark, sf):
    return rounded(ps.followup_pairs(_w3(spark, sf)))


# --- group values on rows -----------------------------------------------------------------------


@query(
    "w5_group_size",
    "SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier",
)
def _(spark, sf):
    supplier = b.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return with_group_count(supplier, ["s_nationkey"])


K_SQL = """k AS (SELECT SAMPLE_POINT_NAME, CLASS, count(*) AS N FROM e GROUP BY ALL)"""


def _class_counts(spark, sf):
    return dist.class_counts_present(b.decorated_events(spark, sf), SITE)


@query(
    "w6_share_of_group",
    f"""WITH {E}, {K_SQL} SELECT SAMPLE_POINT_NAME, CLASS, N,
  {_r('N / sum(N) OVER (PARTITION BY SAMPLE_POINT_NAME)')} AS FRAC FROM k""",
)
def _(spark, sf):
    return rounded(_class_counts(spark, sf).drop("N_GROUP"))


@query(
    "w7_group_total",
    f"""WITH {E}, {K_SQL} SELECT SAMPLE_POINT_NAME, CLASS, N,
  CAST(sum(N) OVER (PARTITION BY SAMPLE_POINT_NAME) AS BIGINT) AS N_GROUP FROM k""",
)
def _(spark, sf):
    return _class_counts(spark, sf).drop("FRAC")


# --- histograms and boxes --------------------------------------------------------------------------


@query(
    "h1_log_histogram",
    f"""WITH {E}, k AS (SELECT CAST(ceil((log10(ENTEROCOCCI) - 0.15e0) / 0.3e0) AS BIGINT) AS bin, count(*) AS n FROM e
  WHERE routine AND ENTEROCOCCI > 0 GROUP BY 1)
  SELECT bin, {_r('0.15e0 + bin * 0.3e0 - 0.3e0')} AS lo, {_r('0.15e0 + bin * 0.3e0')} AS hi, n FROM k""",
)
def _(spark, sf):
    routine = b.decorated_events(spark, sf).filter("SAMPLE_TYPE = 'Routine'")
    return rounded(dist.histogram(routine, width=0.3, boundary=0.15, log10=True))


@query(
    "h2_linear_histogram",
    f"""WITH {E}, k AS (SELECT CAST(ceil((ENTEROCOCCI - 5) / 10) AS BIGINT) AS bin, count(*) AS n FROM e
  WHERE routine AND ENTEROCOCCI < 200 GROUP BY 1)
  SELECT bin, CAST(5 + bin * 10 - 10 AS DOUBLE) AS lo, CAST(5 + bin * 10 AS DOUBLE) AS hi, n FROM k""",
)
def _(spark, sf):
    routine = b.decorated_events(spark, sf).filter("SAMPLE_TYPE = 'Routine'")
    return dist.histogram(routine.filter("ENTEROCOCCI < 200"))


@query(
    "h3_capped_histogram",
    f"""WITH {E}, k AS (SELECT SAMPLE_POINT_NAME, {BINNED} AS CLASS,
  CAST(ceil(least(ENTEROCOCCI, 400) / 10) AS BIGINT) AS bin, count(*) AS n FROM e
  WHERE SAMPLE_TYPE IN ('Routine', 'Resample') GROUP BY ALL)
  SELECT SAMPLE_POINT_NAME, CLASS, CAST(bin * 10 - 10 AS DOUBLE) AS lo, CAST(bin * 10 AS DOUBLE) AS hi, n FROM k""",
)
def _(spark, sf):
    chosen = xp.explore(b.decorated_events(spark, sf), ["Routine", "Resample"])
    return dist.capped_histogram(xp.time_series(chosen, "binned"))


def _box_sql(keys: str, source: str) -> str:
    return f"""q AS (SELECT {keys}, quantile_cont(v, 0.25e0) AS q1, quantile_cont(v, 0.5e0) AS median,
    quantile_cont(v, 0.75e0) AS q3, count(*) AS n FROM {source} GROUP BY ALL),
  j AS (SELECT {source}.*, q1, median, q3, n, v BETWEEN q1 - (q3 - q1) * 1.5e0 AND q3 + (q3 - q1) * 1.5e0 AS inside
    FROM {source} JOIN q ON {' AND '.join(f'{source}.{k} IS NOT DISTINCT FROM q.{k}' for k in keys.split(', '))}),
  bx AS (SELECT {keys}, q1, median, q3, min(v) FILTER (inside) AS whisker_lo, max(v) FILTER (inside) AS whisker_hi, n
    FROM j GROUP BY ALL)"""


BOX_COLUMNS = ", ".join(f"{_r(c)} AS {c}" for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi"))
TIDE_SQL = f"""tv AS (SELECT SAMPLE_POINT_NAME, CASE WHEN TIDE IN ({', '.join(f"'{t}'" for t in TIDE_LEVELS)}) THEN TIDE END AS TIDE,
  log10(CASE WHEN ENTEROCOCCI > 0 THEN ENTEROCOCCI END) AS v0 FROM w), tx AS (SELECT SAMPLE_POINT_NAME, TIDE, v0 AS v FROM tv WHERE v0 IS NOT NULL)"""


def _tides(spark, sf):
    return as_ordered(b.wide_samples(spark, sf), "TIDE", TIDE_LEVELS)


@query(
    "h4_box_by_tide",
    f"""WITH {b.WIDE_SQL}, {TIDE_SQL}, {_box_sql('SAMPLE_POINT_NAME, TIDE', 'tx')},
  lv AS (SELECT SAMPLE_POINT_NAME, unnest([{', '.join(f"'{t}'" for t in TIDE_LEVELS)}]) AS TIDE FROM (SELECT DISTINCT SAMPLE_POINT_NAME FROM tv))
  SELECT coalesce(bx.SAMPLE_POINT_NAME, lv.SAMPLE_POINT_NAME) AS SAMPLE_POINT_NAME, coalesce(bx.TIDE, lv.TIDE) AS TIDE,
  {BOX_COLUMNS}, coalesce(n, 0) AS n FROM lv FULL OUTER JOIN bx ON lv.SAMPLE_POINT_NAME = bx.SAMPLE_POINT_NAME AND lv.TIDE IS NOT DISTINCT FROM bx.TIDE""",
)
def _(spark, sf):
    return rounded(dist.box_stats(_tides(spark, sf), [SITE, "TIDE"], log10=True, levels=TIDE_LEVELS))


@query(
    "h4_box_outliers_by_tide",
    f"""WITH {b.WIDE_SQL}, {TIDE_SQL}, {_box_sql('SAMPLE_POINT_NAME, TIDE', 'tx')}
  SELECT SAMPLE_POINT_NAME, TIDE, {_r('v')} AS ENTEROCOCCI, count(*) AS n FROM j WHERE NOT inside GROUP BY SAMPLE_POINT_NAME, TIDE, v""",
)
def _(spark, sf):
    return rounded(dist.box_outliers(_tides(spark, sf), [SITE, "TIDE"], log10=True))


@query(
    "h4_box_by_user_events",
    f"""WITH {E}, tx AS (SELECT SAMPLE_POINT_NAME, SAMPLE_TYPE, log10(ENTEROCOCCI) AS v FROM e WHERE ENTEROCOCCI > 0),
  {_box_sql('SAMPLE_POINT_NAME, SAMPLE_TYPE', 'tx')} SELECT SAMPLE_POINT_NAME, SAMPLE_TYPE, {BOX_COLUMNS}, n FROM bx""",
)
def _(spark, sf):
    return rounded(dist.box_stats(b.decorated_events(spark, sf), [SITE, "SAMPLE_TYPE"], log10=True))


@query(
    "h5_box_of_class_shares",
    f"""WITH {O}, {A9_SQL}, tx AS (SELECT SAMPLE_POINT_NAME, 'F_CLEAN' AS VAR, N_CLEAN / N AS v FROM a9
  UNION ALL SELECT SAMPLE_POINT_NAME, 'F_70', N_70 / N FROM a9 UNION ALL SELECT SAMPLE_POINT_NAME, 'F_104', N_104 / N FROM a9),
  {_box_sql('SAMPLE_POINT_NAME, VAR', 'tx')} SELECT SAMPLE_POINT_NAME, VAR, {BOX_COLUMNS}, n FROM bx""",
)
def _(spark, sf):
    long = unpivot(_a9(spark, sf), [SITE, "YEAR"], ["F_CLEAN", "F_70", "F_104"], name="VAR")
    return rounded(dist.box_stats(long, [SITE, "VAR"], x="VALUE"))


# --- calendars ----------------------------------------------------------------------------------------


def _cells_sql(name: str, source: str, cls: str, where: str = "TRUE", lo: int = 20, hi: int = 46) -> str:
    return f"""{name}0 AS (SELECT *, {b.calweek_sql('SAMPLE_DATE')} AS wk FROM {source}),
  {name} AS (SELECT SAMPLE_POINT_NAME, YEAR, CASE WHEN wk BETWEEN {lo} AND {hi} THEN wk END AS WEEK,
  {b.weekday_sql('SAMPLE_DATE')} AS WEEKDAY, {cls} AS CLASS, SAMPLE_TYPE FROM {name}0 WHERE {where})"""


THREE = b.class_sql(350000, 425000, "<70")
TWO = "CASE WHEN ENTEROCOCCI > 425000 THEN '>104' ELSE '<104' END"


@query("h6_calendar_three_classes", f"WITH {O}, {_cells_sql('cc', 'o', THREE)} SELECT * FROM cc")
def _(spark, sf):
    return xp.calendar_cells(b.calendar_orders(spark, sf), limits=b.ORDER_LIMITS)


@query(
    "h6_calendar_two_classes",
    f"WITH {O}, {_cells_sql('cc', 'o', TWO)} SELECT * FROM cc WHERE WEEK <= 38",
)
def _(spark, sf):
    return xp.calendar_cells(
        b.calendar_orders(spark, sf), classes="two", max_week=38, limits=b.ORDER_LIMITS
    )


@query(
    "h6_calendar_without_resamples",
    f"WITH {O}, {_cells_sql('cc', 'o', THREE, 'NOT RESAMPLE')} SELECT * FROM cc WHERE WEEK <= 38",
)
def _(spark, sf):
    return xp.calendar_cells(
        b.calendar_orders(spark, sf), max_week=38, resamples=False, limits=b.ORDER_LIMITS
    )


@query(
    "h6_calendar_interval_classes",
    f"WITH {E}, {_cells_sql('cc', 'e', BINNED, 'TRUE', 2, 4)} SELECT * FROM cc",
)
def _(spark, sf):
    return xp.calendar_cells(b.calendar_events(spark, sf), classes="binned")


@query(
    "h7_full_calendar",
    f"""WITH {O}, {_cells_sql('cc', 'o', THREE)},
  grid AS (SELECT SAMPLE_POINT_NAME, YEAR, CAST(wk.w AS INTEGER) AS WEEK, wd.d AS WEEKDAY FROM (SELECT DISTINCT SAMPLE_POINT_NAME, YEAR FROM cc)
  CROSS JOIN (SELECT unnest(range(20, 47)) AS w) wk CROSS JOIN (SELECT unnest(['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat']) AS d) wd)
  SELECT SAMPLE_POINT_NAME, YEAR, WEEK, WEEKDAY, CLASS, SAMPLE_TYPE FROM cc UNION ALL
  SELECT grid.*, NULL, NULL FROM grid WHERE NOT EXISTS (SELECT 1 FROM cc
    WHERE cc.SAMPLE_POINT_NAME IS NOT DISTINCT FROM grid.SAMPLE_POINT_NAME AND cc.YEAR IS NOT DISTINCT FROM grid.YEAR
      AND cc.WEEK = grid.WEEK AND cc.WEEKDAY = grid.WEEKDAY)""",
)
def _(spark, sf):
    cells = xp.calendar_cells(b.calendar_orders(spark, sf), limits=b.ORDER_LIMITS)
    return xp.calendar_full(cells)


# --- explorer ---------------------------------------------------------------------------------------------


@query(
    "h8_time_series",
    f"""WITH {E} SELECT SAMPLE_POINT_NAME, SAMPLE_DATE, {_r('ENTEROCOCCI')} AS ENTEROCOCCI, {b.class_sql(70, 104, '<70')} AS CLASS
  FROM e WHERE SAMPLE_TYPE IN ('Routine', 'Irregular')""",
)
def _(spark, sf):
    chosen = xp.explore(b.decorated_events(spark, sf), ["Routine", "Irregular"])
    return rounded(xp.time_series(chosen))




@query(
    "h9_covariate_pairs",
    f"""WITH {b.WIDE_SQL} SELECT SAMPLE_POINT_NAME, ACCUMULATION AS COVARIATE, ENTEROCOCCI, {BINNED} AS CLASS,
  PAST_WEATHER AS FACET FROM w WHERE ACCUMULATION IS NOT NULL""",
)
def _(spark, sf):
    wide = harmonise(b.wide_samples(spark, sf))
    return xp.covariate_pairs(wide, "ACCUMULATION", "PAST_WEATHER")


@query(
    "h9_covariate_pairs_ungrouped",
    f"""WITH {b.WIDE_SQL} SELECT SAMPLE_POINT_NAME, SALINITY AS COVARIATE, ENTEROCOCCI, {BINNED} AS CLASS
  FROM w WHERE SALINITY IS NOT NULL""",
)
def _(spark, sf):
    return xp.covariate_pairs(b.wide_samples(spark, sf), "SALINITY")


PLACED_SQL = """pl AS (SELECT SAMPLE_POINT_NAME, SITE_NAME, TOWN, 40e0 + n_nationkey AS LATITUDE, -70e0 + n_nationkey * 0.5e0 AS LONGITUDE FROM st)"""
A15_ORDERS_SQL = A15_SQL.format(source="o").replace("> 104", "> 425000").replace("< 104", "< 425000").replace("> 70", "> 350000")


def _placed(spark, sf):
    nation = F.col("n_nationkey")
    return b.nations(spark, sf).select(
        SITE, "SITE_NAME", "TOWN",
        (F.lit(40.0) + nation).alias("LATITUDE"),
        (F.lit(-70.0) + nation * 0.5).alias("LONGITUDE"),
    )


@query(
    "h11_map_metric",
    f"""WITH {O}, {PLACED_SQL}, {A15_ORDERS_SQL} SELECT pl.SAMPLE_POINT_NAME, LATITUDE, LONGITUDE, {_r('FRAC_GT_SSM * 100')} AS value,
  (SELECT {_r('min(FRAC_GT_SSM) * 100')} FROM a15) AS domain_lo, (SELECT {_r('max(FRAC_GT_SSM) * 100')} FROM a15) AS domain_hi
  FROM pl LEFT JOIN a15 USING (SAMPLE_POINT_NAME)""",
)
def _(spark, sf):
    stats = ex.site_statistics(b.order_samples(spark, sf), limits=b.ORDER_LIMITS)
    placed = station_stats_dim(_placed(spark, sf), stats)
    return rounded(xp.map_metric(placed, stats, "FRAC_GT_SSM"))


@query(
    "h12_site_info",
    f"""WITH {b.NATIONS_SQL}, {PLACED_SQL},
  o AS (SELECT st.SAMPLE_POINT_NAME, floor(o_totalprice / 4000) AS ENTEROCOCCI FROM orders JOIN customer ON o_custkey = c_custkey JOIN st ON c_nationkey = n_nationkey),
  {A15_SQL.format(source='o')}, x AS (SELECT * FROM pl LEFT JOIN a15 USING (SAMPLE_POINT_NAME))
  SELECT SAMPLE_POINT_NAME, 'Town' AS FIELD, TOWN AS VALUE FROM x UNION ALL SELECT SAMPLE_POINT_NAME, 'Beach', SITE_NAME FROM x
  UNION ALL SELECT SAMPLE_POINT_NAME, 'Station ID', SAMPLE_POINT_NAME FROM x
  UNION ALL SELECT SAMPLE_POINT_NAME, 'Latitude', CAST(round(LATITUDE, 6) AS VARCHAR) FROM x
  UNION ALL SELECT SAMPLE_POINT_NAME, 'Longitude', CAST(round(LONGITUDE, 6) AS VARCHAR) FROM x
  UNION ALL SELECT SAMPLE_POINT_NAME, '# Samples', CAST(COUNT AS VARCHAR) FROM x
  UNION ALL SELECT SAMPLE_POINT_NAME, 'Geomean Ent. (MPN/100mL)', CAST(round(CAST(GEOMEAN AS DOUBLE), 6) AS VARCHAR) FROM x
  UNION ALL SELECT SAMPLE_POINT_NAME, 'Median Ent. (MPN/100mL)', CAST(round(MEDIAN, 6) AS VARCHAR) FROM x""",
)
def _(spark, sf):
    samples = b.order_samples(spark, sf).withColumn(
        "ENTEROCOCCI", F.floor(F.col("ENTEROCOCCI") / 4000).cast("double")
    )
    placed = station_stats_dim(_placed(spark, sf), ex.site_statistics(samples))
    return xp.site_info(placed)


@query(
    "h13_exploration_filter",
    f"""WITH {E} SELECT id, SAMPLE_TYPE, {_r('ENTEROCOCCI')} AS ENTEROCOCCI FROM e
  WHERE SAMPLE_POINT_NAME = '7' AND SAMPLE_TYPE IN ('Routine', 'Resample')""",
)
def _(spark, sf):
    chosen = xp.explore(b.decorated_events(spark, sf), ["Routine", "Resample"], value="7")
    return rounded(chosen.select("id", "SAMPLE_TYPE", "ENTEROCOCCI"))
