"""Raw rows to the flagged sample table, on a small hand-made programme."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.model import (
    CATEGORICAL_NAMES,
    CATEGORY_RULES,
    NONDETECT_QUALIFIER,
    NUMERIC_NAMES,
    RAW_COLUMNS,
    SAMPLE_DEPTH_RULE,
    SAMPLE_KEYS,
)
from strandline.operators.joins import KEY, as_columns
from strandline.operators.reshape import pivot_strict, unlisted
from strandline.plans import checks
from strandline.plans.assembly import (
    assign_ids,
    build_samples,
    extract_categories,
    extract_numeric,
    merge_variables,
    widen,
)
from strandline.plans.flags import assign_flags, fold_ledger
from strandline.plans.ingest import standardise, standardise_names, typed_rows
from strandline.plans.stations import build_stations
from strandline.sources.tables import (
    raw_schema,
    read_flags,
    read_raw,
    read_stage,
    write_csv,
    write_stage,
)
from tests.conftest import as_set, plan_of

DAY1, DAY2, DAY3 = datetime(2015, 7, 6, 9), datetime(2015, 7, 7, 9), datetime(2015, 1, 5)


def raw(sample, when, kind, name, value=None, qualifier=None, limit=None, point="P-01", site="  East Beach\t"):
    row = {
        "SITE SEQUENCE NUMBER": "12.0", "SAMPLE SEQUENCE NUMBER": "7", "TOWN": "Harbour",
        "SITE NAME": site, "SAMPLE POINT NAME": point, "SAMPLE DATE": when, "SAMPLE TYPE": kind,
        "DEP SAMPLE ID": sample, "PARAMETER NAME": name, "CONCENTRATION": value,
        "CONCENTRATION QUALIFIER": qualifier, "QUANITATION LIMIT": limit,
        "SITE LATITUDE (UTM)": "4780000", "SITE LONGITUDE (UTM)": "370000", "REMARKS": "x",
    }
    return tuple(row[c] for c in RAW_COLUMNS)


WATER, AIR = "SURFACE WATER", "AIR"
FULL = [
    (WATER, "ENTEROCOCCI", "75"), (AIR, "TEMPERATURE", "21.5"), (WATER, "TEMPERATURE", "16"),
    (WATER, "SALINITY (FROM SODIUM)", "30"), ("X", "ACCUMULATION LAST 24 HOURS", "0.5"),
    ("X", "ACCUMULATION LAST 48 HOURS", "1"), ("X", "CURRENT WEATHER CLEAR", None),
    ("X", "PAST 24HR WEATHER LIGHT RAIN", None), ("X", "PAST 48HR WEATHER NO RAIN", None),
    ("X", "TIDE STAGE: HIGH EBB", None), ("X", "WATER SURFACE RAPID CURRENT", None),
    ("X", "WATER SURFACE CALM", None), ("X", "SAMPLE DEPTH INTERVAL 0-1 FT", None),
]
ROWS = [
    *[raw("D1", DAY1, *r) for r in FULL],
    *[raw("D2", DAY2, *r) for r in FULL],
    raw("D3", DAY2, "X", "TIDE STAGE: LOW"),                                     # categorical only
    raw("D0", DAY2, WATER, "ENTEROCOCCI", "3", NONDETECT_QUALIFIER, "10"),       # non-detect, parsed
    raw("D4", DAY3, WATER, "ENTEROCOCCI", "<10", "OTHER TEXT", "10"),            # unparseable
    raw("D5", DAY3, WATER, "ENTEROCOCCI", "120", None, None, point="A-01"),
    raw("D5", DAY3, "X", "ACCUMULATION LAST 72 HOURS", "9", point="A-01"),       # unlisted name
    raw("D6", DAY3, "X", "ACCUMULATION LAST 72 HOURS", "9"),                     # only unlisted
    raw("D5", DAY3, WATER, "ENTEROCOCCI", "120", None, None, point="A-01"),      # exact copy
    raw("D5", DAY3, WATER, "ENTEROCOCCI", "120", None, None, point="A-01", site="East Beach"),  # copy after trim
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, raw_schema())


def test_names_and_types(rows):
    named = standardise_names(rows, drop=[len(RAW_COLUMNS) - 1])
    assert "SITE_LATITUDE_UTM" in named.columns and "REMARKS" not in named.columns
    first = typed_rows(rows).first()
    assert (first.SITE_SEQUENCE_NUMBER, first.SITE_NAME, first.SITE_LATITUDE_UTM) == (12, "East Beach", 4780000.0)
    assert standardise(rows).count() == len(ROWS) - 2


def test_categories(rows):
    clean = standardise(rows)
    d1 = extract_categories(clean).filter("DEP_SAMPLE_ID = 'D1'")
    assert as_set(d1, "PARAMETER_NAME", "VALUE") == {
        ("CURRENT_WEATHER", "CLEAR"), ("PAST_WEATHER_24HR", "LIGHT RAIN"),
        ("PAST_WEATHER_48HR", "NO RAIN"), ("TIDE", "HIGH EBB"), ("CURRENT", "RAPID CURRENT"),
        ("WATER_SURFACE", "CALM"),
    }
    depth = extract_categories(clean, [*CATEGORY_RULES, SAMPLE_DEPTH_RULE])
    assert depth.filter("VALUE = '0-1 FT'").count() == 2


def test_one_row_may_match_two_rules(spark, rows):
    both = rows.limit(1).withColumn("PARAMETER NAME", F.lit("CURRENT WEATHER TIDE STAGE: X"))
    assert extract_categories(standardise(both)).count() == 2


def test_numbers_and_nondetects(rows):
    numeric = extract_numeric(standardise(rows))
    ent = numeric.filter("PARAMETER_NAME = 'ENTEROCOCCI'")
    assert as_set(ent, "DEP_SAMPLE_ID", "VALUE") == {
        ("D1", 75.0), ("D2", 75.0), ("D0", 10.0), ("D4", None), ("D5", 120.0),
    }
    assert as_set(numeric.filter("DEP_SAMPLE_ID = 'D1'"), "PARAMETER_NAME", "VALUE") == {
        ("ENTEROCOCCI", 75.0), ("TEMP_AIR", 21.5), ("TEMP_WATER", 16.0), ("SALINITY", 30.0),
        ("ACCUMULATION_24HR", 0.5), ("ACCUMULATION_48HR", 1.0),
    }
    rejected = unlisted(numeric, "PARAMETER_NAME", NUMERIC_NAMES)
    assert as_set(rejected, "DEP_SAMPLE_ID") == {("D5",), ("D6",)}


def test_single_pivot_equals_two_pivots_and_a_merge(rows):
    clean = standardise(rows)
    merged = merge_variables(
        pivot_strict(extract_categories(clean), SAMPLE_KEYS, "PARAMETER_NAME", "VALUE", CATEGORICAL_NAMES),
        pivot_strict(extract_numeric(clean), SAMPLE_KEYS, "PARAMETER_NAME", "VALUE", NUMERIC_NAMES),
    )
    wide = widen(typed_rows(rows))
    assert as_set(wide, *merged.columns) == as_set(merged, *merged.columns)
    assert wide.count() == 7


def _merged(clean, keys):
    def wide(cells, names):
        return pivot_strict(cells, keys, "PARAMETER_NAME", "VALUE", names)

    return merge_variables(
        wide(extract_categories(clean, keys=keys), CATEGORICAL_NAMES),
        wide(extract_numeric(clean, keys=keys), NUMERIC_NAMES),
        keys,
    )


def test_keys_as_one_give_what_keys_apart_give(spark, rows):
    """NULLs in some and in all keys, copies in other tasks, samples of one side only."""
    lost = [raw(None, None, *r, point=None) for r in FULL]
    lost += [raw(None, DAY1, *FULL[0]), raw("D9", None, *FULL[9]), raw("D9", DAY1, *FULL[9], point=None)]
    odd = spark.createDataFrame([*lost, *ROWS[:5], *lost], raw_schema())
    more = rows.unionByName(odd).repartition(5).localCheckpoint()
    apart = _merged(standardise(more), list(SAMPLE_KEYS))
    for tasks in (None, 1, 7):
        together = as_columns(_merged(standardise(more, by=SAMPLE_KEYS, tasks=tasks), [KEY]))
        assert together.dtypes == apart.dtypes
        assert sorted(map(repr, together.collect())) == sorted(map(repr, apart.collect()))
    assert apart.count() == 11
    one = standardise(more, by=SAMPLE_KEYS, tasks=3)
    assert sorted(map(repr, as_columns(one).select(*standardise(more).columns).collect())) == sorted(
        map(repr, standardise(more).collect())
    )


def test_full_merge_shuffles_raw_rows_once(spark, small):
    """Distinct rows, both pivots and the merge find a sample's rows where one shuffle put them."""
    merged = entry.queries()["j1_full_outer_merge"](spark, small)
    merged.collect()
    tree = plan_of(merged, "simple").split("== Initial Plan ==")
    final = tree[0]
    assert final.count("Exchange hashpartitioning") - final.count("ReusedExchange") <= 1
    assert tree[-1].count("hashpartitioning") == tree[-1].count(f"hashpartitioning({KEY}") == 2


def test_differing_rows_in_one_cell_fail(spark, rows):
    clash = spark.createDataFrame([raw("D1", DAY1, WATER, "ENTEROCOCCI", "76")], raw_schema())
    with pytest.raises(PySparkException, match="ENTEROCOCCI"):
        widen(typed_rows(rows.unionByName(clash))).collect()
    long = extract_numeric(standardise(rows.unionByName(clash)))
    duplicated = checks.duplicate_cells(long, SAMPLE_KEYS, "PARAMETER_NAME")
    assert as_set(duplicated, "DEP_SAMPLE_ID", "PARAMETER_NAME", "n") == {("D1", "ENTEROCOCCI", 2)}


def test_equal_values_in_differing_rows_still_fail(spark, rows):
    clash = spark.createDataFrame([raw("D1", DAY1, WATER, "ENTEROCOCCI", "75", "NOTE")], raw_schema())
    with pytest.raises(PySparkException, match="ENTEROCOCCI"):
        widen(typed_rows(rows.unionByName(clash))).collect()


def test_ids_follow_merge_order_and_keep_gaps(rows):
    ids = assign_ids(widen(typed_rows(rows)))
    order = [r.DEP_SAMPLE_ID for r in ids.orderBy("id").collect()]
    # categorical side by (point, sample, date), then numeric only by (point, date, sample)
    assert order == ["D1", "D2", "D3", "D5", "D4", "D6", "D0"]
    samples = build_samples(typed_rows(rows))
    assert as_set(samples, "id", "DEP_SAMPLE_ID", "WEEK", "WEEKDAY") == {
        (1, "D1", 28, "Mon"), (2, "D2", 28, "Tue"), (4, "D5", None, "Mon"), (7, "D0", 28, "Tue"),
    }


def test_widen_scans_once_and_shuffles_once(spark, rows, tmp_path):
    rows.withColumnsRenamed({c: c.replace(" ", "_") for c in RAW_COLUMNS}).write.parquet(str(tmp_path / "r"))
    plan = plan_of(widen(typed_rows(spark.read.parquet(str(tmp_path / "r")))))
    tree = plan.split("\n\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("Scan parquet") == 1
    # Whole-row copies are recognised from every column but the dropped one.
    assert "REMARKS" not in plan


def test_stations(rows):
    stations = build_stations(typed_rows(rows))
    assert as_set(stations, "SAMPLE_POINT_NAME", "SITE_NAME") == {("P-01", "East Beach"), ("A-01", "East Beach")}
    row = stations.first()
    assert 43 < row.LATITUDE < 43.5 and -71 < row.LONGITUDE < -70


# --- sources ---------------------------------------------------------------------


def test_raw_round_trip_keeps_blanks(spark, rows, tmp_path):
    write_csv(rows, str(tmp_path / "raw"))
    back = read_raw(spark, str(tmp_path / "raw"))
    assert back.schema == raw_schema()
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_stage_is_partitioned_and_pruned(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 4 + 2010).cast("int").alias("YEAR"))
    path = str(tmp_path / "stage")
    write_stage(df, path, ["YEAR"])
    back = read_stage(spark, path)
    assert as_set(back, "id", "YEAR") == as_set(df, "id", "YEAR")
    assert "PartitionFilters: [isnotnull(YEAR" in plan_of(back.filter("YEAR = 2012"))


def test_flag_list(spark, tmp_path):
    (tmp_path / "flags.csv").write_text('"id","stn"\n12,"P-01"\n3,"A-01"\n')
    assert as_set(read_flags(spark, str(tmp_path)), "id", "stn") == {(12, "P-01"), (3, "A-01")}


# --- flags and checks ---------------------------------------------------------------


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(1, "P"), (2, "P"), (4, "A"), (6, "A")], "id long, SAMPLE_POINT_NAME string")


def flags(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, stn string")


def test_flags_default_to_false(spark, samples):
    out = assign_flags(samples, flags(spark, (2, "P"), (4, "P")), flags(spark, (6, "A")))
    assert as_set(out, "id", "RESAMPLE", "OTHER") == {
        (1, False, False), (2, True, False), (4, False, False), (6, False, True),
    }


def test_ledger_keeps_ids_last_added(spark):
    edits = spark.createDataFrame(
        [
            ("resample", 1, 10, "P", "add"), ("resample", 2, 10, "P", "remove"), ("resample", 3, 10, "P", "add"),
            ("resample", 1, 11, "P", "add"), ("resample", 4, 11, "P", "remove"),
            ("other", 5, 11, "P", "add"), ("other", 1, 12, "A", "remove"),
        ],
        "list string, step int, id int, stn string, op string",
    )
    assert as_set(fold_ledger(edits), "list", "id", "stn") == {("resample", 10, "P"), ("other", 11, "P")}


def test_flag_checks(spark, samples):
    bad = flags(spark, (99, "P"), (1, "A"), (2, "P"), (2, "P"))
    assert as_set(checks.dangling_flags(bad, samples), "id", "stn") == {(99, "P")}
    assert as_set(checks.inconsistent_flags(bad, samples), "id", "flag_point", "sample_point", "reason") == {
        (1, "A", "P", "point differs"), (2, "P", "P", "duplicate"),
    }
    flagged = assign_flags(samples, flags(spark, (1, "P")), flags(spark, (6, "A")))
    assert as_set(checks.flag_count_gap(bad, flagged, "RESAMPLE"), "expected", "actual") == {(4, 1)}
    assert checks.flag_count_gap(flags(spark, (1, "P")), flagged, "RESAMPLE").count() == 0


def test_assert_empty(spark, samples):
    checks.assert_empty(samples.filter("id < 0"))
    with pytest.raises(checks.CheckFailed, match="samples: "):
        checks.assert_empty(samples, "samples")


def test_ambiguous_stations(spark):
    stations = spark.createDataFrame(
        [("b", "P", 1.0, 1.0), ("b", "P", 1.0, 2.0), ("b", "P", 1.0, 2.0), ("b", "Q", 1.0, 1.0)],
        "SITE_NAME string, SAMPLE_POINT_NAME string, SITE_LATITUDE_UTM double, SITE_LONGITUDE_UTM double",
    )
    assert as_set(checks.ambiguous_stations(stations), "SAMPLE_POINT_NAME", "SITE_LONGITUDE_UTM", "n") == {
        ("P", 1.0, 2), ("P", 2.0, 2),
    }
