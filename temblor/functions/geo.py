"""Distances and the aftershock radius as column expressions, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius in km, km a degree, and the Gardner-Knopoff radius with its ceiling.
EARTH_KM = 6371.0
KM_DEGREE = 111.0
GK = (0.1238, 0.983, 300.0)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def gk_radius(magnitude: Column) -> Column:
    slope, base, most = GK
    return F.least(F.lit(most), F.pow(F.lit(10.0), slope * magnitude + base))


def haversine_sql(a: str, b: str) -> str:
    return (
        f"2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}.lat - {a}.lat) / 2), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )


def gk_sql(m: str) -> str:
    return f"least(300.0::DOUBLE, pow(10.0::DOUBLE, 0.1238::DOUBLE * {m} + 0.983::DOUBLE))"
