"""Distance joins by grid cells: a range condition becomes an equi-join on cells with a residual distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions.geo import EARTH_M, haversine_m

_DEG_M = math.pi * EARTH_M / 180


def _row(lat: Column, radius_m: float) -> Column:
    """Rows of cells at least radius_m high."""
    return F.floor(lat / (radius_m / _DEG_M * 1.0001))


def _columns(y: Column, radius_m: float) -> Column:
    """How many cells row y has: each as wide as radius_m spans at the latitudes of the row and its neighbours. They wrap at 180 degrees."""
    high, half = radius_m / _DEG_M * 1.0001, math.sin(min(radius_m * 1.0001 / (2 * EARTH_M), math.pi / 2))
    least = F.cos(F.radians(F.least(F.greatest(F.abs(y - 1), F.abs(y + 2)) * high, F.lit(90.0))))
    wide = F.degrees(2 * F.asin(F.least(F.lit(1.0), half / F.greatest(least, F.lit(1e-12)))))
    return F.greatest(F.floor(360 / wide), F.lit(1))


def _column(lon: Column, n: Column) -> Column:
    return F.least(F.floor(F.pmod(lon.cast("double"), F.lit(360.0)) / 360 * n), n - 1)


def within(left: DataFrame, right: DataFrame, radius_m: float, by: tuple[str, ...] = (), left_at: tuple[str, str] = ("lat", "lon"),
           right_at: tuple[str, str] = ("r_lat", "r_lon")) -> DataFrame:
    """Inner join of rows at most radius_m apart (and equal in the by columns), with dist_m. Column names of the sides must differ but for by.

    The right side is filed once under its cell, the left side under its own and the eight around it.
    """
    (la, lo), (ra, ro) = left_at, right_at
    y = _row(F.col(la), radius_m)
    a = left.where(F.col(la).isNotNull() & F.col(lo).isNotNull()).withColumn("_y", F.explode(F.array(y - 1, y, y + 1)))
    a = a.withColumn("_n", _columns(F.col("_y"), radius_m)).withColumn("_x", _column(F.col(lo), F.col("_n")))
    beside = F.array(F.pmod(F.col("_x") - 1, F.col("_n")), F.col("_x"), F.pmod(F.col("_x") + 1, F.col("_n")))
    # near the poles a row has one or two cells, which are their own neighbours
    a = a.withColumn("_x", F.explode(F.when(F.col("_n") > 2, beside).otherwise(F.array_distinct(beside))))
    b = right.where(F.col(ra).isNotNull() & F.col(ro).isNotNull()).withColumnsRenamed({c: f"_by_{c}" for c in by}).withColumn("_ry", _row(F.col(ra), radius_m))
    b = b.withColumn("_rx", _column(F.col(ro), _columns(F.col("_ry"), radius_m)))
    # latitudes alone rule out many pairs of cells that touch
    on = (F.col("_y") == F.col("_ry")) & (F.col("_x") == F.col("_rx")) & (F.abs(F.col(la) - F.col(ra)) <= radius_m / _DEG_M * 1.0001)
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = a.join(b, on).drop(*(f"_by_{c}" for c in by))
    d = haversine_m(F.col(la), F.col(lo), F.col(ra), F.col(ro))
    return joined.withColumn("dist_m", d).where(F.col("dist_m") <= radius_m).drop("_y", "_x", "_n", "_ry", "_rx")


def nearest(left: DataFrame, right: DataFrame, radius_m: float, key: str, order: str, left_at: tuple[str, str] = ("lat", "lon"),
            right_at: tuple[str, str] = ("r_lat", "r_lon"), keep: tuple[str, ...] = ()) -> DataFrame:
    """For each left key the nearest right row within the radius: key, dist_m, order and the kept columns. Equal distances go to the lower order.

    Rows at the very same place are one point of the join, on either side: a standing vehicle or a pole with many signs costs no pairs. The minimum
    is aggregated map-side; no row is sorted.
    """
    places = right.groupBy(*right_at).agg(F.min(F.struct(order, *keep)).alias("_r"))
    pairs = within(left.select(*left_at).distinct(), places, radius_m, (), left_at, right_at)
    best = pairs.groupBy(*left_at).agg(F.min(F.struct("dist_m", "_r")).alias("b"))
    found = left.select(key, *left_at).join(best, list(left_at))
    return found.select(key, F.col("b.dist_m").alias("dist_m"), F.col("b._r").getField(order).alias(order), *(F.col("b._r").getField(k).alias(k) for k in keep))
