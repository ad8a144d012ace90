"""Limits, declared level lists, and the rule tables that drive ingestion.

Data only: the functions that interpret these live in ``functions``, ``operators``
and ``plans``.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Limits:
    """A proposed (low) and a current (high) action limit."""

    low: float = 70.0
    high: float = 104.0


# --- fixed values: level lists and labels -------------------------------------

WEEKDAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
SEASON_WEEKS = (20, 46)
SAMPLE_TYPES = ("Routine", "Resample", "Irregular")

CLASS_LABELS = ("<70", "70-104", ">104")
CLASS_LABELS_INCLUSIVE = ("<=70", "70-104", ">104")
TWO_CLASS_LABELS = ("<104", ">104")

TIDE_LEVELS = (
    "LOW", "LOW FLOOD", "FLOOD", "HIGH FLOOD", "HIGH", "HIGH EBB", "EBB", "LOW EBB",
)
CURRENT_WEATHER_LEVELS = ("CLEAR", "PARTLY CLOUDY", "OVERCAST", "RAIN")
PAST_WEATHER_LEVELS = ("NO RAIN", "LIGHT RAIN", "MEDIUM RAIN", "HIGH RAIN")
CURRENT_LEVELS = ("SLOW CURRENT", "MEDIUM CURRENT", "RAPID CURRENT")

STATION_INFO_LABELS = {
    "TOWN": "Town",
    "SITE_NAME": "Beach",
    "SAMPLE_POINT_NAME": "Station ID",
    "LATITUDE": "Latitude",
    "LONGITUDE": "Longitude",
    "COUNT": "# Samples",
    "GEOMEAN": "Geomean Ent. (MPN/100mL)",
    "MEDIAN": "Median Ent. (MPN/100mL)",
}

NONDETECT_QUALIFIER = "NOT DETECTED ABOVE THE ASSOCIATED QUANTITATION LIMIT"

SAMPLE_KEYS = ("SAMPLE_POINT_NAME", "DEP_SAMPLE_ID", "SAMPLE_DATE")

CATEGORICAL_NAMES = (
    "CURRENT", "CURRENT_WEATHER", "PAST_WEATHER_24HR", "PAST_WEATHER_48HR", "TIDE",
    "WATER_SURFACE",
)
NUMERIC_NAMES = (
    "ACCUMULATION_24HR", "ACCUMULATION_48HR", "ENTEROCOCCI", "SALINITY", "TEMP_AIR",
    "TEMP_WATER",
)

# Raw header, as delivered (text except the sample date).
RAW_DATE_COLUMN = "SAMPLE DATE"
RAW_COLUMNS = (
    "SITE SEQUENCE NUMBER", "SAMPLE SEQUENCE NUMBER", "TOWN", "SITE NAME",
    "SAMPLE POINT NAME", "SAMPLE DATE", "SAMPLE TYPE", "DEP SAMPLE ID",
    "PARAMETER NAME", "CONCENTRATION", "CONCENTRATION QUALIFIER",
    "QUANITATION LIMIT", "SITE LATITUDE (UTM)", "SITE LONGITUDE (UTM)", "REMARKS",
)
RAW_DROPPED = ("REMARKS",)
RAW_RENAMES = {
    "SITE_LATITUDE_(UTM)": "SITE_LATITUDE_UTM",
    "SITE_LONGITUDE_(UTM)": "SITE_LONGITUDE_UTM",
}
RAW_TYPES = {
    "QUANITATION_LIMIT": "number",
    "SITE_NAME": "trim",
    "SITE_SEQUENCE_NUMBER": "integer",
    "SAMPLE_SEQUENCE_NUMBER": "integer",
    "SITE_LATITUDE_UTM": "number",
    "SITE_LONGITUDE_UTM": "number",
}


@dataclass(frozen=True)
class CategoryRule:
    """A category whose value is written inside the parameter name.

    ``ends_with`` adds a second test on the name's ending; ``negate_end`` inverts it.
    """

    name: str
    contains: str
    marker: str
    ends_with: str | None = None
    negate_end: bool = False


@dataclass(frozen=True)
class NumericRule:
    """A measured variable: which rows it takes and what it is called.

    A name found in ``recode`` is renamed; any other keeps its own name unless
    ``rename_to`` forces one for every selected row.
    """

    contains: str | None = None
    names: tuple[str, ...] = ()
    sample_type: str | None = None
    recode: dict[str, str] = field(default_factory=dict)
    rename_to: str | None = None
    nondetect: bool = False


# --- fixed values: parameter vocabulary ---------------------------------------

CATEGORY_RULES = (
    CategoryRule("CURRENT_WEATHER", "CURRENT WEATHER", "CURRENT WEATHER "),
    CategoryRule("PAST_WEATHER_24HR", "PAST 24HR WEATHER", "PAST 24HR WEATHER "),
    CategoryRule("PAST_WEATHER_48HR", "PAST 48HR WEATHER", "PAST 48HR WEATHER "),
    CategoryRule("TIDE", "TIDE STAGE", "TIDE STAGE: "),
    CategoryRule("CURRENT", "WATER SURFACE", "WATER SURFACE ", ends_with="CURRENT"),
    CategoryRule(
        "WATER_SURFACE", "WATER SURFACE", "WATER SURFACE ",
        ends_with="CURRENT", negate_end=True,
    ),
)
# Extracted on request only: nothing downstream uses it.
SAMPLE_DEPTH_RULE = CategoryRule(
    "SAMPLE_DEPTH_INTERVAL", "SAMPLE DEPTH INTERVAL", "SAMPLE DEPTH INTERVAL "
)

NUMERIC_RULES = (
    NumericRule(
        contains="ACCUMULATION",
        recode={
            "ACCUMULATION LAST 48 HOURS": "ACCUMULATION_48HR",
            "ACCUMULATION LAST 24 HOURS": "ACCUMULATION_24HR",
        },
    ),
    NumericRule(sample_type="AIR", rename_to="TEMP_AIR"),
    NumericRule(
        sample_type="SURFACE WATER",
        names=("TEMPERATURE", "SALINITY (FROM SODIUM)"),
        recode={"TEMPERATURE": "TEMP_WATER", "SALINITY (FROM SODIUM)": "SALINITY"},
    ),
    NumericRule(names=("ENTEROCOCCI",), nondetect=True),
)
