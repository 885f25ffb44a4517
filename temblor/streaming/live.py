"""Streams of events: counts with a watermark, de-duplication, alerts with hysteresis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from .ordered import InOrder, in_order, rocks

COOLDOWN = 7200
#: Levels of a zone's hourly top magnitude; alerts go out from the second level.
LEVELS = (3.5, 4.0, 4.5, 5.0)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with event time and zone."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    lon = -180.0 + F.pmod(F.col("user_id") * 53, F.lit(360)) + F.pmod(F.col("event_id") * 104729, F.lit(1000)) / 5000.0
    return e.select("event_id", F.col("ts").cast("timestamp").alias("time"), (F.lit(2.5) + F.floor(F.col("value") / 11.5) / 10.0).alias("magnitude"), F.floor((lon + 180) / 30).alias("zone"))


def finished(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """What the stream has given once all input at hand is read."""
    spark = stream.sparkSession
    path = shared_dir(spark, label)
    if mode == "complete":
        sink = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    else:
        sink = stream.writeStream.outputMode(mode).format("parquet").option("path", path)
    with rocks(spark):
        sink.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def hourly_counts(events: DataFrame) -> DataFrame:
    counts = events.withWatermark("time", "6 hours").groupBy("zone", F.window("time", "1 hour")).agg(F.count("*").alias("n"), F.max("magnitude").alias("top"))
    return counts.select("zone", F.floor(F.unix_seconds("window.start") / 3600).alias("hour"), "n", "top")


def first_reports(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The first report of each key within the watermark."""
    return events.withWatermark("time", "1 day").dropDuplicatesWithinWatermark([key])


def level(magnitude: float) -> int:
    return sum(magnitude >= x for x in LEVELS)


def judge(times: list[float], magnitudes: list[float], before: tuple[int, float] | None) -> tuple[list[tuple[float, int]], tuple[int, float] | None]:
    """Alerts (time, level) of readings in order of time: a rise to level 2 or above alerts unless the last alert is within the cooldown; the first reading sets the level only."""
    out = []
    for t, m in zip(times, magnitudes, strict=True):
        now = level(m)
        if before is None:
            before = (now, float("-inf"))
            continue
        was, alerted = before
        if now > was and now >= 2 and t - alerted >= COOLDOWN:
            out.append((t, now))
            alerted = t
        before = (now, alerted)
    return out, before


def alert_fold(rows: list[tuple], kept: list[tuple], until: float) -> tuple[list[tuple], list[tuple], None]:
    """Rows (t, event_id, magnitude); kept are a zone's level and the time of its last alert, or nothing."""
    out, state = judge([r[0] for r in rows], [r[2] for r in rows], kept[0] if kept else None)
    return out, [state] if state else [], None


def alerts(events: DataFrame, delay: int = 0) -> DataFrame:
    """zone, t, level of alerts; the state of a zone is its level, the time of its last alert, and what the watermark has not passed."""
    seconds = events.select("zone", "event_id", (F.unix_micros("time") / 1e6).alias("t"), "magnitude")
    return in_order(seconds, "zone", InOrder("t double, event_id long, magnitude double", "level long, alerted double", "zone long, t double, level long", alert_fold), delay)
