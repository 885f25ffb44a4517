"""Joins of events that are near each other in space and time.

A theta join on distance would compare all pairs.  Here both sides get a cell:
bands of latitude twice as high as the radius, cells of longitude about as wide (whole
cells round the globe, so the antimeridian needs no rule) and buckets of time.  One side
is posted under its own cell, the other under the cells that its circle and window touch, about four
and seven; the join is an equi-join on the cell, which Spark can split where a region is dense, and the
exact conditions are checked on what meets.

Where each row has a reach of its own, rows are cut into classes of radii, each half the next, and each
class has its own cells: the few that reach far don't widen the cells of all others."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, KM_DEGREE, haversine

#: The smallest class of radii is at most this wide, in km.
FINE_KM = 40.0
DAY = 86400.0


def _radii(km: float) -> list[float]:
    radii = [km]
    while radii[0] > FINE_KM:
        radii.insert(0, radii[0] / 2)
    return radii


def _cells(band: Column, height: Column) -> Column:
    """Cells on a band, about as wide as it is high; one near a pole."""
    edge = F.greatest(F.abs(band * height), F.abs((band + 1) * height))
    return F.when(edge >= 85, 1).otherwise(F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / height))).cast("int")


def cells_of(df: DataFrame, height: Column) -> DataFrame:
    """df with the band and cell of each row's lat and lon, for bands ``height`` degrees high."""
    df = df.withColumn("band", F.floor(F.col("lat") / height).cast("int")).withColumn("cells", _cells(F.col("band"), height))
    return df.withColumn("cell", F.pmod(F.floor((F.col("lon") + 180) / 360 * F.col("cells")), F.col("cells")).cast("int")).drop("cells")


def touched_cells(df: DataFrame, height: float, km: float | Column) -> DataFrame:
    """A row for each band and cell that the circle of ``km`` round a row's lat and lon touches."""
    up = F.lit(km) * (1.0001 * 180 / math.pi / EARTH_KM) + 1e-9
    aside = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(up)) / F.cos(F.radians("lat"))))) * 1.0001 + 1e-9
    df = df.withColumn("aside", F.when(F.abs("lat") + up >= 89.9, 180.0).otherwise(aside))
    df = df.withColumn("band", F.explode(F.sequence(F.floor((F.col("lat") - up) / height).cast("int"), F.floor((F.col("lat") + up) / height).cast("int")))).withColumn("cells", _cells(F.col("band"), F.lit(height)))
    at = lambda lon: F.floor((lon + 180) / 360 * F.col("cells"))
    first, last = at(F.col("lon") - F.col("aside")), at(F.col("lon") + F.col("aside"))
    touched = F.sequence(first, F.least(last, first + F.col("cells") - 1))
    return df.withColumn("cell", F.explode(F.transform(touched, lambda c: F.pmod(c, F.col("cells")).cast("int")))).drop("cells", "aside")


def _vector(lat: Column, lon: Column) -> dict[str, Column]:
    lat, lon = F.radians(lat), F.radians(lon)
    return {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}


def neighbours(left: DataFrame, right: DataFrame, km: float, back: float = 0.0, ahead: float = 0.0, reach: Column | None = None) -> DataFrame:
    """Pairs l.*, r.* (as structs) with r.ep in [l.ep - back, l.ep + ahead], at most ``km`` apart, and their km.

    Both sides have lat, lon, ep; ``reach``, of columns of left, is a radius for each row (``km`` at most); further conditions are the caller's filters."""
    radii = [km] if reach is None else _radii(km)
    window = max(back + ahead, 1.0)
    span = max(window / 6, min(window, DAY))
    height = F.col("radius") * 2.02 / KM_DEGREE
    bucket = lambda ep: F.floor(ep / span).cast("long")
    b = right.select(F.struct(*right.columns).alias("r"), *(v.alias(f"r{k}") for k, v in _vector(right["lat"], right["lon"]).items()), F.explode(F.array(*map(F.lit, radii))).alias("radius"))
    b = b.withColumn("band", F.floor(F.col("r.lat") / height).cast("int")).withColumn("cells", _cells(F.col("band"), height))
    b = b.select("r", "rx", "ry", "rz", "radius", "band", F.pmod(F.floor((F.col("r.lon") + 180) / 360 * F.col("cells")), F.col("cells")).cast("int").alias("cell"), bucket(F.col("r.ep")).alias("bucket"))
    far = F.lit(float(km)) if reach is None else F.least(reach, F.lit(float(km)))
    a = left.select(F.struct(*left.columns).alias("l"), far.alias("reach"), *(v.alias(f"l{k}") for k, v in _vector(left["lat"], left["lon"]).items()))
    # The smallest class that holds the reach, the degrees that the circle spans, and the square of its chord.
    narrow = F.array_min(F.filter(F.array(*map(F.lit, radii)), lambda x: x >= F.col("reach")))
    a = a.withColumns({"radius": F.coalesce(narrow, F.lit(float(km))), "up": F.col("reach") * (1.0001 * 180 / math.pi / EARTH_KM) + 1e-9, "chord": F.pow(2 * F.sin(F.col("reach") / (2 * EARTH_KM)), 2)})
    aside = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("up")) / F.cos(F.radians("l.lat"))))) * 1.0001 + 1e-9
    a = a.withColumn("aside", F.when(F.abs("l.lat") + F.col("up") >= 89.9, 180.0).otherwise(aside))
    a = a.withColumn("band", F.explode(F.sequence(F.floor((F.col("l.lat") - F.col("up")) / height).cast("int"), F.floor((F.col("l.lat") + F.col("up")) / height).cast("int")))).withColumn("cells", _cells(F.col("band"), height))
    at = lambda lon: F.floor((lon + 180) / 360 * F.col("cells"))
    first, last = at(F.col("l.lon") - F.col("aside")), at(F.col("l.lon") + F.col("aside"))
    touched = F.sequence(first, F.least(last, first + F.col("cells") - 1))
    a = a.withColumn("cell", F.explode(F.transform(touched, lambda c: F.pmod(c, F.col("cells")).cast("int"))))
    a = a.withColumn("bucket", F.explode(F.sequence(bucket(F.col("l.ep") - back), bucket(F.col("l.ep") + ahead))))
    # Pairs are many more than rows: the join is dealt out by cell even where a side is small enough to be broadcast to the few tasks that read it.
    met = a.join(b.hint("merge"), ["radius", "band", "cell", "bucket"]).where((F.col("r.ep") >= F.col("l.ep") - back) & (F.col("r.ep") <= F.col("l.ep") + ahead))
    apart = haversine(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon"))
    # The chord decides without trigonometry; only what lies on the edge of the circle needs the arc.
    square = sum(((F.col(f"l{k}") - F.col(f"r{k}")) * (F.col(f"l{k}") - F.col(f"r{k}")) for k in "yz"), (F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")))
    inside = (square <= F.col("chord") * (1 - 1e-9) - 1e-15) | ((square <= F.col("chord") * (1 + 1e-9) + 1e-15) & (apart <= F.col("reach")))
    return met.where(inside).select("l", "r", apart.alias("km"))
