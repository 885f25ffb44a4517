"""Deterministic seismic tables from the driver's tables (Spark), and the same views as SQL.

Only integer arithmetic goes into positions and magnitudes, so that both agree to the bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts):
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, event_id, ep (seconds), magnitude, depth_km, lat, lon."""
    e = table(spark, sf_dir, "events")
    prefix = F.element_at(F.array(*map(F.lit, ("us", "ak", "ci", "emsc:", "emsc_"))), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    return e.select(
        F.concat(prefix, F.col("event_id").cast("string")).alias("id"),
        "event_id",
        seconds(F.col("ts")).alias("ep"),
        (F.lit(2.5) + F.floor(F.col("value") / 11.5) / 10.0).alias("magnitude"),
        F.pmod(F.col("event_id") * 31, F.lit(300)).cast("double").alias("depth_km"),
        (-60.0 + F.pmod(F.col("user_id") * 37, F.lit(120)) + F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 5000.0).alias("lat"),
        (-180.0 + F.pmod(F.col("user_id") * 53, F.lit(360)) + F.pmod(F.col("event_id") * 104729, F.lit(1000)) / 5000.0).alias("lon"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, metric, ep, value: a narrow table of signals."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("source"), F.col("event_type").alias("metric"), "event_id", seconds(F.col("ts")).alias("ep"), "value")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, lat, lon from the suppliers."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("station"), (-60.0 + F.pmod(F.col("s_suppkey") * 41, F.lit(120))).cast("double").alias("lat"), (-180.0 + F.pmod(F.col("s_suppkey") * 67, F.lit(360))).cast("double").alias("lon"))


def zones(spark: SparkSession) -> DataFrame:
    """Twelve bands of longitude, in order, each 35 degrees wide so that neighbours overlap."""
    return spark.range(12).select(F.col("id").alias("zone"), (-180.0 + F.col("id") * 30).alias("lon_lo"), (-145.0 + F.col("id") * 30).alias("lon_hi"))


QUAKES = """quakes AS (
  SELECT CASE event_id % 5 WHEN 0 THEN 'us' WHEN 1 THEN 'ak' WHEN 2 THEN 'ci' WHEN 3 THEN 'emsc:' ELSE 'emsc_' END || event_id AS id, event_id,
    epoch_us(ts) / 1e6 AS ep, 2.5 + floor(value / 11.5) / 10.0 AS magnitude, CAST((event_id * 31) % 300 AS DOUBLE) AS depth_km,
    -60.0::DOUBLE + ((user_id * 37) % 120) + ((event_id * 7919) % 1000) / 5000.0::DOUBLE AS lat,
    -180.0::DOUBLE + ((user_id * 53) % 360) + ((event_id * 104729) % 1000) / 5000.0::DOUBLE AS lon
  FROM events)"""
SAMPLES = "samples AS (SELECT event_type AS source, event_type AS metric, event_id, epoch_us(ts) / 1e6 AS ep, value FROM events)"
STATIONS = "stations AS (SELECT CAST(s_suppkey AS BIGINT) AS station, CAST(-60.0 + (s_suppkey * 41) % 120 AS DOUBLE) AS lat, CAST(-180.0 + (s_suppkey * 67) % 360 AS DOUBLE) AS lon FROM supplier)"
ZONES = "zones AS (SELECT range AS zone, CAST(-180.0 + range * 30 AS DOUBLE) AS lon_lo, CAST(-145.0 + range * 30 AS DOUBLE) AS lon_hi FROM range(12))"
