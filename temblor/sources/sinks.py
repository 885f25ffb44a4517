"""Writing results: only new rows, by year, one line an hour, audited removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def only_new(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df whose keys are not in ``existing``, one for each key; null keys are equal to each other."""
    on = [df[k].eqNullSafe(existing[k]) for k in keys]
    return df.join(existing.select(*keys).distinct(), on, "left_anti").dropDuplicates(keys)


def by_year(df: DataFrame, path: str, ep: str = "ep") -> None:
    """Hive-style year folders; rows of a year are dealt over several files when there are many."""
    df.withColumn("year", F.year(F.timestamp_seconds(ep))).repartition("year", F.pmod(F.hash(ep), F.lit(8))).write.mode("append").partitionBy("year").parquet(path)


def one_line_an_hour(df: DataFrame, archive: DataFrame, ep: str = "ep") -> DataFrame:
    """JSON lines of hours that the archive has not yet: the newest state of each hour."""
    hour = F.floor(F.col(ep) / 3600)
    last = df.groupBy(hour.alias("hour")).agg(F.max_by(F.struct(*df.columns), ep).alias("state"))
    return last.join(archive.select("hour"), "hour", "left_anti").select("hour", F.to_json("state").alias("line"))


def audited(df: DataFrame, losers: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(survivors, removed with the id that was kept); losers has key and kept_id."""
    return df.join(losers, key, "left_anti"), df.join(losers, key)
