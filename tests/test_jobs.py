"""The whole programme, from raw files to report tables."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.plans import jobs
from strandline.plans.checks import CheckFailed
from strandline.model import RAW_COLUMNS
from strandline.queries import bindings as b
from strandline.queries import ingest
from strandline.queries.registry import REGISTRY
from strandline.sources.tables import read_flags, read_raw, read_stage, write_csv, write_stage
from tests.conftest import plan_of


@pytest.fixture(scope="module")
def out(spark, small, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("programme"))
    raw = b.raw_rows(spark, small)
    # Another column order than the declared one, as the header decides.
    write_csv(raw.select(*[F.col(f"`{c}`") for c in reversed(RAW_COLUMNS)]), f"{base}/raw")
    jobs.assemble(spark, f"{base}/raw", base)
    samples = read_stage(spark, f"{base}/samples")
    pick = F.col("SAMPLE_POINT_NAME").alias("stn")
    write_csv(samples.filter("CURRENT = 'RAPID CURRENT'").select("id", pick), f"{base}/resamples")
    write_csv(samples.filter("CURRENT_WEATHER = 'FOG' AND CURRENT <> 'RAPID CURRENT'").select("id", pick), f"{base}/others")
    jobs.flag(spark, base, f"{base}/resamples", f"{base}/others")
    return base


def test_stages(spark, out, small):
    flagged = read_stage(spark, f"{out}/flagged")
    samples = read_stage(spark, f"{out}/samples")
    assert flagged.count() == samples.count() == samples.select("id").distinct().count()
    assert set(flagged.columns) == {*samples.columns, "RESAMPLE", "OTHER"}
    assert flagged.filter("RESAMPLE AND OTHER").count() == 0
    assert read_stage(spark, f"{out}/stations").count() > 0


def test_rejects_and_coverage(spark, out):
    merged, samples = (read_stage(spark, f"{out}/{n}") for n in ("merged", "samples"))
    assert merged.filter("ENTEROCOCCI IS NOT NULL").count() == samples.count() < merged.count()
    rejects = read_stage(spark, f"{out}/rejects")
    assert {r.PARAMETER_NAME for r in rejects.select("PARAMETER_NAME").distinct().collect()} == {
        "ACCUMULATION LAST 72 HOURS"
    }
    keys = ["SAMPLE_POINT_NAME", "DEP_SAMPLE_ID", "SAMPLE_DATE"]
    assert rejects.select(keys).subtract(merged.select(keys)).count() == 0
    counted = read_stage(spark, f"{out}/coverage_numeric").filter("PARAMETER_NAME = 'SALINITY'")
    assert counted.agg(F.sum("n")).first()[0] == merged.agg(F.count("SALINITY")).first()[0]


def test_dates_in_another_form(spark, tmp_path, small):
    raw = b.raw_rows(spark, small)
    shown = F.date_format("SAMPLE DATE", "M/d/yyyy HH:mm:ss")
    write_csv(raw.withColumn("SAMPLE DATE", shown), str(tmp_path / "raw"))
    jobs.assemble(spark, str(tmp_path / "raw"), str(tmp_path), timestamp_format="M/d/yyyy HH:mm:ss")
    years = {r[0] for r in read_stage(spark, f"{tmp_path}/merged").select("YEAR").distinct().collect()}
    assert years and years <= {r[0] for r in raw.select(F.year("SAMPLE DATE")).distinct().collect()}
    assert None not in years
    with pytest.raises(PySparkException):
        jobs.assemble(spark, str(tmp_path / "raw"), str(tmp_path / "x"))


def test_dropped_column_by_position(spark, tmp_path, small):
    raw = b.raw_rows(spark, small).withColumnRenamed("REMARKS", "FREE TEXT")
    twice = raw.unionByName(raw.withColumn("FREE TEXT", F.lit("differs")))
    write_csv(twice, str(tmp_path / "raw"))
    jobs.assemble(spark, str(tmp_path / "raw"), str(tmp_path), drop=[raw.columns.index("FREE TEXT")])
    with pytest.raises(PySparkException, match="more than one value"):
        jobs.assemble(spark, str(tmp_path / "raw"), str(tmp_path / "x"), drop=[])


def test_flag_list_binds_by_header(spark, tmp_path):
    write_csv(spark.createDataFrame([("P", 7)], "stn string, id long"), str(tmp_path / "f"))
    assert [tuple(r) for r in read_flags(spark, str(tmp_path / "f")).collect()] == [(7, "P")]
    write_csv(spark.createDataFrame([("x", "P")], "id string, stn string"), str(tmp_path / "g"))
    with pytest.raises(PySparkException, match="no number"):
        read_flags(spark, str(tmp_path / "g")).collect()
    write_csv(spark.createDataFrame([("x",)], "id string"), str(tmp_path / "h"))
    with pytest.raises(ValueError, match="stn"):
        read_flags(spark, str(tmp_path / "h"))


def test_shared_tables_are_planned_once(spark, out):
    seen = []

    def keep(name, df):
        seen.append(name)
        return df

    tables = jobs.report_tables(
        read_stage(spark, f"{out}/flagged"), read_stage(spark, f"{out}/stations"), keep=keep
    )
    for name in ("map_median", "map_count", "site_info", "rank_curve", "mean_extra_total",
                 "followup_pairs", "resample_pairs_by_gap", "low_limit_by_site"):
        tables[name]()
    assert sorted(seen) == sorted(set(seen))


def test_every_report_table(spark, out):
    jobs.report(spark, out)
    tables = jobs.report_tables(read_stage(spark, f"{out}/flagged"), read_stage(spark, f"{out}/stations"))
    assert len(tables) > 50
    counts = {name: spark.read.parquet(f"{out}/reports/{name}").count() for name in tables}
    may_be_empty = {
        "repeat_exceedance_by_site", "initial_resample_by_site", "followup_pairs",
        "ambiguous_stations", "multiple_per_day", "resample_without_exceedance",
        "calendar_three_classes", "calendar_two_classes", "calendar_without_resamples",
    } | {n for n in tables if n.startswith("box_outliers")}
    assert [n for n, c in counts.items() if c == 0 and n not in may_be_empty] == []
    proportions = spark.read.parquet(f"{out}/reports/class_proportions")
    assert proportions.agg(F.sum("FREQ")).first()[0] == pytest.approx(1.0)


def test_failed_count_leaves_the_former_stage(spark, out, monkeypatch):
    former = sorted(read_stage(spark, f"{out}/flagged").select("id", "RESAMPLE").collect())
    wrong = lambda flags, written, name: spark.range(1)
    monkeypatch.setattr(jobs.checks, "flag_count_gap", wrong)
    with pytest.raises(CheckFailed, match="RESAMPLE count"):
        jobs.flag(spark, out, f"{out}/others", f"{out}/resamples")
    assert sorted(read_stage(spark, f"{out}/flagged").select("id", "RESAMPLE").collect()) == former
    assert [x for x in os.listdir(out) if ".new-" in x or ".old-" in x] == []


def test_failed_write_leaves_the_former_stage(spark, tmp_path):
    path = str(tmp_path / "stage")
    write_stage(spark.range(3), path)
    with pytest.raises(PySparkException):
        write_stage(spark.range(5).select(F.raise_error(F.lit("broken")).alias("id")), path)
    assert read_stage(spark, path).count() == 3
    write_stage(read_stage(spark, path).where("id > 0"), path)  # also from what it replaces
    assert read_stage(spark, path).count() == 2 and os.listdir(tmp_path) == ["stage"]


def test_class_tables_read_the_samples_once(spark, out, tmp_path):
    kept = []

    def keep(name, df):
        kept.append(name)
        write_stage(df, f"{tmp_path}/{name}")
        return read_stage(spark, f"{tmp_path}/{name}")

    tables = jobs.report_tables(
        read_stage(spark, f"{out}/flagged"), read_stage(spark, f"{out}/stations"), keep=keep
    )
    names = [n for n in tables if n.startswith(("class_counts", "class_shares", "share_"))]
    names += ["class_proportions", "class_proportions_above"]
    assert len(names) == 10
    for name in names:
        assert f"{out}/flagged" not in plan_of(tables[name]())
    assert kept == ["class_counts"]


def test_ambiguous_stations_and_unmatched_keys(spark, out):
    unmatched = read_stage(spark, f"{out}/unmatched")
    keys = ["SAMPLE_POINT_NAME", "DEP_SAMPLE_ID", "SAMPLE_DATE"]
    merged = read_stage(spark, f"{out}/merged")
    assert unmatched.count() > 0 and unmatched.subtract(merged.select(keys)).count() == 0
    assert "n" in read_stage(spark, f"{out}/ambiguous_stations").columns


def test_inconsistent_lists_stop_the_job(spark, out, tmp_path):
    first = read_stage(spark, f"{out}/samples").select(F.min("id").alias("id"))
    bad = first.withColumn("stn", F.lit("nowhere"))
    write_csv(bad, str(tmp_path / "bad"))
    with pytest.raises(CheckFailed, match="RESAMPLE list"):
        jobs.flag(spark, out, str(tmp_path / "bad"), f"{out}/others")


def test_missing_raw_column_is_an_error(spark, tmp_path):
    write_csv(spark.createDataFrame([("a",)], "TOWN string"), str(tmp_path / "raw"))
    with pytest.raises(ValueError, match="SAMPLE DATE"):
        read_raw(spark, str(tmp_path / "raw"))


def test_raw_rows_come_from_tasks_of_bounded_size(spark, small, monkeypatch):
    """However orders are split and joined, a task multiplies about ORDERS_PER_TASK of them."""
    whole = b.raw_rows(spark, small).count()
    monkeypatch.setattr(b, "ORDERS_PER_TASK", 100, raising=False)
    for limit in ("-1", "10m"):  # customers by a shuffle, and broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            raw = b.raw_rows(spark, small)
            orders = raw.groupBy(F.spark_partition_id().alias("task")).agg(
                F.count(F.lit(1)).alias("rows"), F.count_distinct("DEP SAMPLE ID").alias("n")
            )
            seen = orders.collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sum(r.rows for r in seen) == whole
        assert max(r.n for r in seen) <= 200


def test_raw_scan_writes_compressed_text(spark, small, monkeypatch, tmp_path):
    monkeypatch.setattr(ingest, "_scratch", lambda spark, name: str(tmp_path / name))
    found = REGISTRY["io1_raw_scan"].job(spark, small)
    written = sum(f.stat().st_size for f in (tmp_path / "raw").glob("part-*"))
    rows = found.count()
    assert rows == b.raw_rows(spark, small).count()
    assert written < 40 * rows  # 150 as plain text
