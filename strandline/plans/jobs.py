"""The programme's jobs in run order: assemble, flag, report.

Each reads the tables the one before wrote, so a lost cluster costs one job at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from strandline.functions.calendar import add_calendar
from strandline.functions.classify import as_ordered, decorate, harmonise
from strandline.model import (
    CATEGORICAL_NAMES,
    CURRENT_LEVELS,
    CURRENT_WEATHER_LEVELS,
    NUMERIC_NAMES,
    PAST_WEATHER_LEVELS,
    RAW_DROPPED,
    SAMPLE_KEYS,
    TIDE_LEVELS,
    Limits,
)
from strandline.operators.handover import handovers
from strandline.operators.ranking import rank_by
from strandline.operators.reshape import unpivot
from strandline.plans import checks
from strandline.plans import distribution as dist
from strandline.plans import exceedance as ex
from strandline.plans import explore as xp
from strandline.plans import persistence as ps
from strandline.plans.assembly import (
    extract_categories,
    extract_numeric,
    merged_samples,
    rejected_cells,
    with_result,
)
from strandline.plans.flags import assign_flags
from strandline.plans.ingest import typed_rows
from strandline.plans.stations import (
    attach_station,
    build_stations,
    station_choices,
    station_stats_dim,
)
from strandline.sources.tables import (
    read_flags,
    read_raw,
    read_stage,
    write_csv,
    write_stage,
)

SITE, BEACH = "SAMPLE_POINT_NAME", "SITE_NAME"
COVARIATE_LEVELS = {
    "TIDE": TIDE_LEVELS,
    "CURRENT_WEATHER": CURRENT_WEATHER_LEVELS,
    "PAST_WEATHER": PAST_WEATHER_LEVELS,
    "CURRENT": CURRENT_LEVELS,
}
COVARIATES = ("ACCUMULATION", "TEMP_WATER", "TEMP_AIR", "SALINITY")


#: The raw file's free-text column, by position: its name varies.
REMARKS_AT = 30


def assemble(
    spark: SparkSession,
    raw_path: str,
    out: str,
    fmt: str = "csv",
    zone: int = 19,
    timestamp_format: str | None = None,
    drop: Sequence[int | str] | None = None,
) -> None:
    """Raw rows to the stages ``samples`` and ``stations``, also exported as CSV.

    ``rejects`` holds cells without a column, ``coverage_*`` counts all merged samples, also
    those without a result. ``ambiguous_stations`` holds points with more than one station row,
    which would repeat their samples in tables by town or beach, ``unmatched`` the keys with
    categorical data only: both are written before any job uses the stages. ``drop`` names raw columns, or their positions, to leave out; by
    default the 31st, or in a narrower file the one called like it.
    """
    raw = read_raw(spark, raw_path, fmt, timestamp_format=timestamp_format)
    if drop is None:
        wide = len(raw.columns) > REMARKS_AT
        drop = [REMARKS_AT] if wide else [c for c in RAW_DROPPED if c in raw.columns]
    typed = typed_rows(raw, drop)
    with handovers(spark):
        write_stage(merged_samples(typed), f"{out}/merged", ["YEAR"])
    merged = read_stage(spark, f"{out}/merged")
    write_stage(with_result(merged), f"{out}/samples", ["YEAR"])
    write_stage(build_stations(typed, zone), f"{out}/stations")
    stations = read_stage(spark, f"{out}/stations")
    coords = ("LATITUDE", "LONGITUDE")
    write_stage(checks.ambiguous_stations(stations, coords=coords), f"{out}/ambiguous_stations")
    keyed = extract_categories(typed).select(*SAMPLE_KEYS).distinct()
    write_stage(checks.unmatched_keys(keyed, extract_numeric(typed)), f"{out}/unmatched")
    write_stage(rejected_cells(typed), f"{out}/rejects")
    for name, columns in (("categorical", CATEGORICAL_NAMES), ("numeric", NUMERIC_NAMES)):
        write_stage(ex.coverage_by_variable(merged, columns), f"{out}/coverage_{name}")
    write_csv(read_stage(spark, f"{out}/samples"), f"{out}/csv/samples")
    write_csv(stations, f"{out}/csv/stations")


def flag(spark: SparkSession, out: str, resamples_path: str, others_path: str) -> None:
    """Samples and the two flag lists to the stage ``flagged``; inconsistent lists fail.

    The stage is published after its flags are counted; a failed check leaves the former one.
    """
    samples = read_stage(spark, f"{out}/samples")
    lists = {"RESAMPLE": read_flags(spark, resamples_path), "OTHER": read_flags(spark, others_path)}
    for name, flags in lists.items():
        checks.assert_empty(checks.dangling_flags(flags, samples), f"{name} ids without a sample")
        checks.assert_empty(checks.inconsistent_flags(flags, samples), f"{name} list against samples")
    flagged = assign_flags(samples, lists["RESAMPLE"], lists["OTHER"])

    def counts_agree(written: DataFrame) -> None:
        for name, flags in lists.items():
            checks.assert_empty(checks.flag_count_gap(flags, written, name), f"{name} count")

    write_stage(flagged, f"{out}/flagged", ["YEAR"], check=counts_agree)
    write_csv(read_stage(spark, f"{out}/flagged"), f"{out}/csv/flagged")


def explorer_samples(flagged: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Flagged samples with classes, harmonised covariates and declared levels."""
    out = harmonise(decorate(flagged, limits=limits))
    for covariate, levels in COVARIATE_LEVELS.items():
        out = as_ordered(out, covariate, levels)
    return out


def report_tables(
    flagged: DataFrame,
    stations: DataFrame,
    limits: Limits = Limits(),
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> dict[str, Callable[[], DataFrame]]:
    """Name -> a function that plans the table; nothing runs until one is called.

    Intermediate tables that several report tables share pass through ``keep`` once; a job
    writes them there and lets the report tables read the copies.
    """
    shared: dict[str, DataFrame] = {}

    def once(name: str, plan: Callable[[], DataFrame]) -> DataFrame:
        if name not in shared:
            shared[name] = keep(name, plan())
        return shared[name]

    # Without stations: a point with several station rows would repeat its samples.
    explorer = explorer_samples(flagged, limits)
    samples = attach_station(explorer, stations)
    routine = samples.filter("SAMPLE_TYPE = 'Routine'")

    def by_year() -> DataFrame:
        return once(
            "site_year_classes", lambda: ex.class_counts_by_site_year(samples, limits=limits)
        )

    def low_limit() -> DataFrame:
        return once(
            "site_year_limits", lambda: ex.low_limit_by_site_year(flagged, limits=limits)
        )

    def previous() -> DataFrame:
        return once(
            "previous", lambda: ps.with_previous_sample(decorate(flagged, limits=limits))
        )

    def followups(initial_only: bool = False) -> DataFrame:
        return ps.followups(previous(), limits=limits, initial_only=initial_only)

    def statistics() -> DataFrame:
        return once("statistics", lambda: ex.site_statistics(flagged, limits=limits))

    def classes(group: str | None = None) -> DataFrame:
        """Class counts by beach, by site and of all, from one pass over the samples."""
        tables = once("class_counts", lambda: dist.class_tables(routine, (BEACH, SITE)))
        return dist.table_of(tables, group)

    def class_means() -> DataFrame:
        return once("class_means", lambda: ex.class_means_by_site(by_year()))

    def located() -> DataFrame:
        return station_stats_dim(stations, statistics())

    def calendar(classes: str, resamples: bool) -> DataFrame:
        return xp.calendar_cells(
            add_calendar(explorer), classes, max_week=38, resamples=resamples, limits=limits
        )

    tables = {
        "coverage_by_site": lambda: ex.coverage_by_site(flagged),
        "type_frequency": lambda: ex.type_frequency(explorer),
        "low_limit_by_site_year": lambda: rank_by(low_limit(), "FRAC_BW_70_104", [SITE, "YEAR"]),
        "low_limit_by_site": lambda: rank_by(
            ex.low_limit_by_site(low_limit()), "MEDIAN_N_RESAMPLE_PER_YEAR"
        ),
        "programme_totals": lambda: ex.programme_totals(ex.low_limit_by_site(low_limit())),
        "classes_by_site_year": by_year,
        "mean_exceedances_by_site": lambda: ex.mean_exceedances_by_site(by_year()),
        "mean_extra_by_site": lambda: ex.mean_extra_by_site(by_year()),
        "extra_by_year": lambda: ex.extra_by_year(by_year()),
        "mean_extra_total": lambda: ex.mean_extra_total(by_year()),
        "class_means_by_site": class_means,
        "rank_curve": lambda: dist.rank_curve(class_means()),
        "rank_curve_exceeding": lambda: dist.rank_curve(class_means(), drop=["N_CLEAN"]),
        "site_statistics": statistics,
        "class_proportions": lambda: dist.proportions(classes()),
        "class_proportions_above": lambda: dist.proportions_above(classes()),
        "box_of_class_shares": lambda: dist.box_stats(
            unpivot(by_year(), [SITE, "YEAR"], ["F_CLEAN", "F_70", "F_104"], name="VAR"),
            [SITE, "VAR"],
            x="VALUE",
        ),
        "log_histogram": lambda: dist.histogram(routine, width=0.3, boundary=0.15, log10=True),
        "linear_histogram": lambda: dist.histogram(routine.filter("ENTEROCOCCI < 200")),
        "capped_histogram": lambda: dist.capped_histogram(
            xp.time_series(explorer, "binned", limits=limits)
        ),
        "repeat_exceedance_by_site": lambda: ps.repeat_exceedance_by_site(previous()),
        "initial_resample_total": lambda: ps.initial_resample_total(followups(True)),
        "initial_resample_by_site": lambda: ps.initial_resample_by_site(followups(True)),
        "followup_pairs": lambda: ps.followup_pairs(followups()),
        "resample_pairs_by_gap": lambda: ps.followup_pairs(previous()),
        "calendar": lambda: xp.calendar_full(
            xp.calendar_cells(add_calendar(explorer), classes="binned", limits=limits)
        ),
        "calendar_three_classes": lambda: calendar("three", resamples=True),
        "calendar_two_classes": lambda: calendar("two", resamples=True),
        "calendar_without_resamples": lambda: calendar("three", resamples=False),
        "time_series": lambda: xp.time_series(explorer, "binned", limits=limits),
        "ambiguous_stations": lambda: checks.ambiguous_stations(
            stations, coords=("LATITUDE", "LONGITUDE")
        ),
        "multiple_per_day": lambda: checks.multiple_per_day(flagged),
        "resample_without_exceedance": lambda: checks.resample_without_exceedance(
            flagged, limits=limits
        ),
        "station_choices": lambda: station_choices(stations),
        "site_info": lambda: xp.site_info(located()),
    }
    for group, slug in ((BEACH, "beach"), (SITE, "site")):
        tables |= {
            f"class_counts_by_{slug}": lambda g=group: dist.counts_filled(classes(g), g),
            f"class_shares_by_{slug}": lambda g=group: dist.shares_filled(classes(g), g),
            f"share_between_by_{slug}": lambda g=group: dist.share_of(classes(g), g),
            f"share_cdf_by_{slug}": lambda g=group: dist.cdf_of_shares(classes(g), g),
        }
    for covariate, levels in COVARIATE_LEVELS.items():
        tables[f"box_by_{covariate.lower()}"] = lambda c=covariate, v=levels: dist.box_stats(
            explorer, [SITE, c], log10=True, levels=v
        )
        tables[f"box_outliers_by_{covariate.lower()}"] = lambda c=covariate: dist.box_outliers(
            explorer, [SITE, c], log10=True
        )
    tables["box_by_water_surface"] = lambda: dist.box_stats(
        explorer, [SITE, "WATER_SURFACE"], log10=True
    )
    for covariate in COVARIATES:
        tables[f"scatter_{covariate.lower()}"] = lambda c=covariate: xp.covariate_pairs(
            explorer, c, limits=limits
        )
        for group in (*COVARIATE_LEVELS, "WATER_SURFACE"):
            tables[f"scatter_{covariate.lower()}_by_{group.lower()}"] = (
                lambda c=covariate, g=group: xp.covariate_pairs(explorer, c, g, limits=limits)
            )
    for metric in xp.METRICS:
        tables[f"map_{metric.lower()}"] = lambda m=metric: xp.map_metric(
            located(), statistics(), m
        )
    return tables


def report(
    spark: SparkSession, out: str, names: Sequence[str] | None = None, limits: Limits = Limits()
) -> None:
    """Write report tables from the stages, each under ``reports/<name>``.

    What several of them share is written once, under ``shared/<name>``.
    """

    def keep(name: str, df: DataFrame) -> DataFrame:
        write_stage(df, f"{out}/shared/{name}")
        return read_stage(spark, f"{out}/shared/{name}")

    tables = report_tables(
        read_stage(spark, f"{out}/flagged"), read_stage(spark, f"{out}/stations"), limits, keep
    )
    with handovers(spark):
        for name in names or tables:
            write_stage(tables[name](), f"{out}/reports/{name}")
