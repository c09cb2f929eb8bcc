"""Distances and coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius of great-circle distances, metres a degree in the plane, metres a degree in corridors.
EARTH_M = 6_371_000.0
PLANE_M_PER_DEG = 111_320.0
CORRIDOR_M_PER_DEG = 111_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; rounding cannot push the arcsine beyond its domain."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_M)


def plane_x(lon: Column, mean_lat: Column) -> Column:
    return lon * PLANE_M_PER_DEG * F.cos(F.radians(mean_lat))


def plane_y(lat: Column) -> Column:
    return lat * PLANE_M_PER_DEG


def valid_fix(lat: Column, lon: Column) -> Column:
    """In range and not the null island that receivers report without a fix."""
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def round_even(value: Column, digits: int) -> Column:
    """Half-to-even rounding of the decimal as it prints, for reports that ask for it; everything else rounds half up."""
    return F.bround(value, digits)


def lerp(a: Column, b: Column, f: Column) -> Column:
    return a + (b - a) * f
