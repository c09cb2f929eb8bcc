"""Class taxonomies and rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The taxonomy of nine classes, by index.
CLASSES = ["Curves", "HighwaySymbols", "Informational", "MileMarkers", "Regulatory", "SpeedLimits", "StopSigns", "TrafficLights", "Warnings"]
# Raw annotation ids to the nine classes; None is dropped.
RAW_TO_CLASS = {
    0: 4, 1: 0, 2: None, 3: 8, 4: 2, 5: 1, 6: 2, 7: 8, 8: 8, 9: 3, 10: None, 11: None, 12: 4, 13: 8, 14: 8, 15: 8, 16: 4, 17: 5, 18: 6, 19: 7, 20: 8, 21: 4,
}
# Sign-code prefixes in order, and categories without a code rule.
CODE_RULES = [("R1-1", "StopSigns"), ("R2", "SpeedLimits"), ("R10", "TrafficLights"), ("W1", "Curves"), ("D10", "MileMarkers"), ("M", "HighwaySymbols"), ("D1", "Informational"), ("OT", "Informational")]
CATEGORY_CLASSES = {"REGULATORY": "Regulatory", "WARNING": "Warnings", "SCHOOL": "Warnings", "OBJECT & END OF ROAD MARKERS": "Regulatory"}
# Prefixes of the fine taxonomy in order, and the class of everything else.
COARSE_RULES = [("regulatory--stop--", 0), ("regulatory--yield--", 1), ("warning--", 2), ("regulatory--maximum-speed-limit-", 3), ("regulatory--minimum-speed-limit-", 3)]
COARSE_DEFAULT = 4
# Classes the inventory lacks; classes shown as one.
NOT_INVENTORIED = ["Warnings"]
MERGED, MERGED_NAME = ["Regulatory", "Informational"], "Informational/Regulatory"


# How likely a road shows a target class; roads not named count 1.
ROAD_AFFINITY = {
    "deerCrossing": {"County Route": 3.0, "WV Route": 2.5, "Federal Aid Non-State": 2.0, "US Route": 1.5, "Municipal Non-State": 0.3, "Interstate": 0.4},
    "pedestrianCrossing": {"Municipal Non-State": 4.0, "US Route": 1.5, "Federal Aid Non-State": 1.0, "WV Route": 1.0, "County Route": 0.5, "Interstate": 0.2},
    "railroadCrossing": {"County Route": 2.0, "WV Route": 2.0, "US Route": 2.0, "Federal Aid Non-State": 1.5, "Municipal Non-State": 1.5, "Interstate": 0.4},
    "curve": {"County Route": 3.0, "WV Route": 2.5, "Federal Aid Non-State": 2.0, "US Route": 1.5, "Municipal Non-State": 0.5, "Interstate": 0.3},
}
# Counties by kind, and how likely a kind shows a target class.
RURAL_COUNTIES = [
    "Pocahontas", "Webster", "Nicholas", "Randolph", "Tucker", "Pendleton", "Grant", "Hardy", "Hampshire", "Morgan", "Mineral", "Upshur",
    "Braxton", "Clay", "Gilmer", "Calhoun", "Wirt", "Roane", "Jackson", "McDowell", "Wyoming", "Logan", "Lincoln", "Mingo",
]
URBAN_COUNTIES = ["Kanawha", "Cabell", "Ohio", "Monongalia", "Wood", "Berkeley", "Jefferson", "Marion", "Harrison", "Raleigh", "Mercer"]
COUNTY_AFFINITY = {
    "deerCrossing": {"rural": 1.6, "urban": 0.6, "other": 1.0},
    "pedestrianCrossing": {"rural": 0.6, "urban": 1.6, "other": 1.0},
    "railroadCrossing": {"rural": 1.1, "urban": 1.1, "other": 1.0},
    "curve": {"rural": 1.5, "urban": 0.5, "other": 1.0},
}
# The road that earns a bonus in counties not yet covered, and the bonus.
NEW_COUNTY_ROAD, NEW_COUNTY_BONUS = "County Route", 2.0


def county_type(county: Column, rural: Sequence[str] = RURAL_COUNTIES, urban: Sequence[str] = URBAN_COUNTIES) -> Column:
    return F.when(county.isin(*rural), "rural").when(county.isin(*urban), "urban").otherwise("other")


def affinity(road: Column, kind: Column, target: str, new_county: Column | None = None, roads: Mapping = ROAD_AFFINITY, kinds: Mapping = COUNTY_AFFINITY, bonus_road: str = NEW_COUNTY_ROAD) -> Column:
    """How promising a video is for a target class: by its road, the kind of its county, and whether its county is new."""
    score = by_map(road, roads[target], 1.0) * by_map(kind, kinds[target], 1.0)
    return score if new_county is None else score * F.when(new_county & (road == bonus_road), NEW_COUNTY_BONUS).otherwise(1.0)


def by_prefix(value: Column, rules: Sequence[tuple[str, object]], default: object = None) -> Column:
    """The result of the first rule whose prefix the value has."""
    found = None
    for prefix, result in rules:
        hit = F.startswith(value, F.lit(prefix))
        found = F.when(hit, F.lit(result)) if found is None else found.when(hit, F.lit(result))
    return F.lit(default) if found is None else found.otherwise(F.lit(default))


def by_map(value: Column, mapping: Mapping, default: object = None) -> Column:
    found = None
    for key, result in mapping.items():
        found = F.when(value == F.lit(key), F.lit(result)) if found is None else found.when(value == F.lit(key), F.lit(result))
    return F.lit(default) if found is None else found.otherwise(F.lit(default))


def normalize_sign_class(code: Column, category: Column, strict_series: bool = False) -> Column:
    """The class of an inventoried sign: by code prefix, else by category. strict_series keeps W10 and R1-10 out of W1 and R1-1."""
    code, category = (F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in (code, category))
    if strict_series:
        cut = F.regexp_extract(code, r"^([A-Z]+\d*(?:-\d+)?)", 1)
        rules = [(F.rlike(cut, F.lit(rf"^{p}(?!\d)" if p[-1].isdigit() else rf"^{p}")), c) for p, c in CODE_RULES]
    else:
        rules = [(F.startswith(code, F.lit(p)), c) for p, c in CODE_RULES]
    found = None
    for hit, name in rules:
        found = F.when(hit, name) if found is None else found.when(hit, name)
    guide = F.when(F.contains(category, F.lit("ROUTE SIGN")), "HighwaySymbols").otherwise("Informational")
    return found.when(F.startswith(category, F.lit("GUIDE")), guide).otherwise(by_map(category, CATEGORY_CLASSES, "Regulatory"))


def collapse(name: Column) -> Column:
    return F.when(name.isin(*MERGED), MERGED_NAME).otherwise(name)
