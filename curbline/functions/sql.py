"""The scalar functions for SQL text, as temporary SQL functions that the optimiser sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

from curbline.functions.classify import CATEGORY_CLASSES, CODE_RULES, MERGED, MERGED_NAME
from curbline.functions.geo import EARTH_M

_CODES = " ".join(f"WHEN startswith(upper(trim(coalesce(code, ''))), '{p}') THEN '{c}'" for p, c in CODE_RULES)
_CATEGORIES = " ".join(f"WHEN upper(trim(coalesce(category, ''))) = '{k}' THEN '{c}'" for k, c in CATEGORY_CLASSES.items())

FUNCTIONS = {
    "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": f"2 * {EARTH_M}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    "size_bucket(share DOUBLE) RETURNS STRING": "CASE WHEN share < 0.001 THEN 'tiny' WHEN share < 0.005 THEN 'small' WHEN share < 0.02 THEN 'medium' ELSE 'large' END",
    "collapse_class(name STRING) RETURNS STRING": f"CASE WHEN name IN ({', '.join(repr(m) for m in MERGED)}) THEN '{MERGED_NAME}' ELSE name END",
    "sign_class(code STRING, category STRING) RETURNS STRING": f"CASE {_CODES} WHEN startswith(upper(trim(coalesce(category, ''))), 'GUIDE') THEN CASE WHEN contains(upper(category), 'ROUTE SIGN') THEN 'HighwaySymbols' ELSE 'Informational' END {_CATEGORIES} ELSE 'Regulatory' END",
    "box_iou(ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE) RETURNS DOUBLE": "coalesce(try_divide(greatest(least(ax2, bx2) - greatest(ax1, bx1), 0D) * greatest(least(ay2, by2) - greatest(ay1, by1), 0D), (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - greatest(least(ax2, bx2) - greatest(ax1, bx1), 0D) * greatest(least(ay2, by2) - greatest(ay1, by1), 0D)), 0D)",
}


def register(spark: SparkSession) -> list[str]:
    """Creates or replaces the functions in the session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
