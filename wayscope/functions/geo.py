"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite; Spark ranks NaN above every number. x is named once: a filter works out x wherever it names it."""
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def _rad(x: Column) -> Column:
    return x * F.pi() / F.lit(180.0)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two positions in degrees; NaN where rounding puts near-antipodes out of the square root's range."""
    half_lat, half_lon = F.sin(_rad(lat2 - lat1) / 2), F.sin(_rad(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * half_lon * half_lon
    return F.lit(EARTH_RADIUS_M) * (F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))
