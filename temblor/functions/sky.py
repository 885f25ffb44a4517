"""The Moon and the Sun as column expressions, and the same as SQL: low-precision series of the almanac (Moon to about 0.3 degrees, Sun to 0.01).

Both forms are made from one text, in which angles are in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gravity times mass in m^3 s^-2, the earth's radius in m, and the astronomical unit in m.
GM_MOON, GM_SUN, EARTH_M, AU_M = 4.902800e12, 1.327124e20, 6.3781e6, 1.495978707e11

#: Fixed values of the series: the Moon's longitude, latitude (sines) and parallax (cosines) as amplitude, angle at the epoch and degrees a century.
MOON_LON = ((6.29, 135.0, 477198.87), (-1.27, 259.3, -413335.36), (0.66, 235.7, 890534.22), (0.21, 269.9, 954397.74), (-0.19, 357.5, 35999.05), (-0.11, 186.5, 966404.03))
MOON_LAT = ((5.13, 93.3, 483202.02), (0.28, 228.2, 960400.89), (-0.28, 318.3, 6003.15), (-0.17, 217.6, -407332.21))
MOON_PARALLAX = ((0.0518, 135.0, 477198.87), (0.0095, 259.3, -413335.36), (0.0078, 235.7, 890534.22), (0.0028, 269.9, 954397.74))


def _series(terms, fn: str) -> str:
    return " + ".join(f"({a}e0) * {fn}(radians({b}e0 + ({c}e0) * century))" for a, b, c in terms)


#: Name and expression, each of those before it; ``ep`` is the time in seconds.  The suffix makes numbers doubles in both engines.
STEPS = (
    ("days", "ep / 86400e0 - 10957.5e0"),
    ("century", "days / 36525e0"),
    ("sun_mean", "radians(357.528e0 + 0.9856003e0 * days)"),
    ("sun_lon", "radians(280.460e0 + 0.9856474e0 * days + 1.915e0 * sin(sun_mean) + 0.020e0 * sin(2 * sun_mean))"),
    ("sun_m", f"{AU_M:.9e} * (1.00014e0 - 0.01671e0 * cos(sun_mean) - 0.00014e0 * cos(2 * sun_mean))"),
    ("tilt", "radians(23.439e0 - 0.0000004e0 * days)"),
    ("moon_lon", f"radians(218.32e0 + 481267.881e0 * century + {_series(MOON_LON, 'sin')})"),
    ("moon_lat", f"radians({_series(MOON_LAT, 'sin')})"),
    ("moon_m", f"{EARTH_M:.4e} / sin(radians(0.9508e0 + {_series(MOON_PARALLAX, 'cos')}))"),
    ("sun_ra", "atan2(cos(tilt) * sin(sun_lon), cos(sun_lon))"),
    ("sun_dec", "asin(sin(tilt) * sin(sun_lon))"),
    ("moon_ra", "atan2(cos(tilt) * cos(moon_lat) * sin(moon_lon) - sin(tilt) * sin(moon_lat), cos(moon_lat) * cos(moon_lon))"),
    ("moon_dec", "asin(sin(tilt) * cos(moon_lat) * sin(moon_lon) + cos(tilt) * sin(moon_lat))"),
    ("elongation", "acos(cos(moon_lat) * cos(moon_lon - sun_lon))"),
    ("greenwich", "radians(15e0 * (18.697374558e0 + 24.06570982441908e0 * days))"),
)
#: What they do at a place: hour angles and cosines of the zenith distance.
LOCAL = (
    ("moon_hour", "greenwich + radians(lon) - moon_ra"),
    ("moon_up", "sin(radians(lat)) * sin(moon_dec) + cos(radians(lat)) * cos(moon_dec) * cos(moon_hour)"),
    ("sun_up", "sin(radians(lat)) * sin(sun_dec) + cos(radians(lat)) * cos(sun_dec) * cos(greenwich + radians(lon) - sun_ra)"),
    ("moon_pull", f"{GM_MOON * EARTH_M**2:.15e} / (moon_m * moon_m * moon_m)"),
    ("sun_pull", f"{GM_SUN * EARTH_M**2:.15e} / (sun_m * sun_m * sun_m)"),
    ("v2", "moon_pull * (3 * moon_up * moon_up - 1) / 2 + sun_pull * (3 * sun_up * sun_up - 1) / 2"),
    ("stress", "least(1e0, abs(v2) / (moon_pull + sun_pull))"),
)


def with_steps(df: DataFrame, steps=STEPS) -> DataFrame:
    """df (ep; for LOCAL lat and lon too) with the columns of ``steps``."""
    for name, expression in steps:
        df = df.withColumn(name, F.expr(expression))
    return df


def steps_sql(table: str, steps=STEPS) -> str:
    """The same over a table: each column may use those before it."""
    return f"SELECT *, {', '.join(f'{expression} AS {name}' for name, expression in steps)} FROM {table}"


def lunar_phase(hour_angle: Column) -> Column:
    """Phase of the half-day tide of the Moon: twice its hour angle, which is 0 when it stands highest or lowest."""
    return 2 * hour_angle
