"""Tidal potential and lunar phases at events and hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sky import LOCAL, STEPS, lunar_phase, steps_sql, with_steps
from ..sources.projection import QUAKES, quakes
from .registry import query
from .series import ZONED, zoned

AT_EVENTS = f"{QUAKES}, sky AS ({steps_sql('quakes', STEPS + LOCAL)})"


@query(f"WITH {AT_EVENTS} SELECT event_id, round(v2, 6) AS v2, round(stress, 8) AS stress FROM sky")
def tidal_potential(spark, sf_dir):
    """Degree-2 potential of Moon and Sun at each event, and its share of the greatest possible."""
    return with_steps(quakes(spark, sf_dir), STEPS + LOCAL).select("event_id", F.round("v2", 6).alias("v2"), F.round("stress", 8).alias("stress"))


@query(f"""WITH {ZONED}, h AS (SELECT hour, hour * 3600.0::DOUBLE AS ep FROM (SELECT unnest(range(min(t) // 3600, max(t) // 3600 + 1)) AS hour FROM z)), s AS ({steps_sql('h')})
SELECT hour, round(abs(cos(elongation)), 8) AS syzygy, round(sin(elongation), 8) AS phase_sin, round(cos(elongation), 8) AS phase_cos, round(pow(384400000.0 / moon_m, 3), 8) AS tidal, round(degrees(moon_dec), 6) AS declination FROM s""")
def lunar_hours(spark, sf_dir):
    """The Moon at every hour of the events' span: how near to new or full, its phase, distance and declination."""
    span = zoned(spark, sf_dir).agg(F.floor(F.min("t") / 3600).alias("a"), F.floor(F.max("t") / 3600).alias("b"))
    s = with_steps(span.select(F.explode(F.sequence("a", "b")).alias("hour")).withColumn("ep", F.col("hour") * F.lit(3600.0)))
    e = F.col("elongation")
    return s.select("hour", F.round(F.abs(F.cos(e)), 8).alias("syzygy"), F.round(F.sin(e), 8).alias("phase_sin"), F.round(F.cos(e), 8).alias("phase_cos"), F.round(F.pow(384400000.0 / F.col("moon_m"), 3), 8).alias("tidal"), F.round(F.degrees("moon_dec"), 6).alias("declination"))


BANDS = "CASE WHEN magnitude < 3 THEN 'small' WHEN magnitude < 4 THEN 'medium' ELSE 'large' END"


@query(f"""WITH {ZONED}, s AS ({steps_sql('z', STEPS + LOCAL)}), a AS (SELECT zone, {BANDS} AS band, count(*) AS n, sum(cos(2 * moon_hour)) AS c, sum(sin(2 * moon_hour)) AS s FROM s GROUP BY GROUPING SETS ((zone, {BANDS}), (zone)))
SELECT zone, coalesce(band, 'all') AS band, n, round(CASE WHEN n < 10 THEN 0 ELSE sqrt(c * c + s * s) / n END, 6) AS r, round(CASE WHEN n < 10 THEN 1 ELSE exp(-(c * c + s * s) / n) END, 6) AS p, round(CASE WHEN n < 10 THEN 0 ELSE atan2(s, c) END, 5) AS mean_phase FROM a""")
def schuster_lunar(spark, sf_dir):
    """Schuster's test of the lunar phase of each event at its own place, by zone and band of magnitude."""
    s = with_steps(zoned(spark, sf_dir), STEPS + LOCAL).withColumns({"band": F.expr(BANDS), "phase": lunar_phase(F.col("moon_hour"))})
    a = s.groupingSets([["zone", "band"], ["zone"]], "zone", "band").agg(F.count("*").alias("n"), F.sum(F.cos("phase")).alias("c"), F.sum(F.sin("phase")).alias("s"))
    few, square = F.col("n") < 10, F.col("c") * F.col("c") + F.col("s") * F.col("s")
    return a.select("zone", F.coalesce("band", F.lit("all")).alias("band"), "n", F.round(F.when(few, 0.0).otherwise(F.sqrt(square) / F.col("n")), 6).alias("r"), F.round(F.when(few, 1.0).otherwise(F.exp(-square / F.col("n"))), 6).alias("p"), F.round(F.when(few, 0.0).otherwise(F.atan2("s", "c")), 5).alias("mean_phase"))
