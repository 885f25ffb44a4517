"""Scores of events as they arrive, kept up to date by the events that a batch touches.

A micro-batch adds its new events to a catalogue of cells (ten degrees) and scores again only what it touches: the new events themselves, and the events at hand
whose look back in time and space holds one of the new, since events may come late.  What is read of the catalogue are the folders of the
cells round about.  Each batch writes its own folder of the catalogue and of the scores, and overwrites it if it runs again after a failure: the table of scores
is the last one written of each event, so that a batch that is repeated changes nothing, and any number of batches gives what one batch of all events gives.

Events older than ``KEEP`` before the newest are not scored any more: the table is a rolling one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import GK, gk_radius
from ..operators.around import strongest_near, tallies

DAY = 86400.0
#: Seconds that events look back, and that the table reaches back.
LOOKBACK, KEEP = 30 * DAY, 2 * DAY
#: Degrees of a cell, which is wider than twice the largest radius below SLIM degrees of latitude; beyond, all cells of a band are neighbours.
CELL, SLIM = 10, 60
EVENTS = "event_id long, ep double, lat double, lon double, magnitude double"


def cell(lat: Column, lon: Column) -> Column:
    """Number of the cell, 648 in all."""
    band = F.floor((F.least(lat, F.lit(89.999)) + 90) / CELL)
    return (band * (360 // CELL) + F.pmod(F.floor((lon + 180) / CELL), F.lit(360 // CELL))).cast("int")


def around(cells: set[int]) -> list[int]:
    """The cells and those next to them."""
    wide, out = 360 // CELL, set()
    for c in cells:
        band, at = divmod(c, wide)
        for b in range(max(0, band - 1), min(180 // CELL, band + 2)):
            polar = max(abs(b * CELL - 90), abs((b + 1) * CELL - 90)) > SLIM
            out |= {b * wide + x % wide for x in (range(wide) if polar else range(at - 1, at + 2))}
    return sorted(out)


def features(events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """event_id, magnitude and what the 30 days before each event hold within its radius; zeros where there was nothing."""
    f = tallies(events, catalogue, GK[2], (DAY, 7 * DAY, LOOKBACK), reach=gk_radius(F.col("magnitude")))
    return f.select("event_id", "ep", "magnitude", F.col("n0").alias("n_24h"), F.col("n1").alias("n_7d"), F.col("n2").alias("n_30d"), F.coalesce("top", F.lit(0.0)).alias("top"), F.round(F.coalesce(F.col("since") / 3600, F.lit(999.0)), 6).alias("hours_since"))


@dataclass
class Scorer:
    """Keeps a catalogue, the scores of events and a line of work for each batch under ``path``; ``score`` is a column of the features."""

    path: str
    score: Column

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = lambda name: f"{self.path}/{name}/batch={number}"
        before = self.catalogue(spark, number)
        new = batch.where("event_id is not null and ep is not null and lat is not null and lon is not null and magnitude is not null").dropDuplicates(["event_id"]).join(before.select("event_id"), "event_id", "left_anti")
        # A file for each cell, not one for each cell and task.
        new.withColumn("cell", cell(F.col("lat"), F.col("lon"))).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(at("catalogue"))
        fresh = self.catalogue(spark, number + 1).where(F.col("batch") == number)
        touched, near, scored = self.cells(fresh), [], 0
        if touched:
            catalogue = self.catalogue(spark, number + 1)
            # The newest event of all: the table's end only moves forward.
            live = F.col("ep") > F.lit(catalogue.agg(F.max("ep")).first()[0] - KEEP)
            near = around(touched)
            held = catalogue.where(F.col("cell").isin(near)).where(live)
            # Late rows change the past of events at hand; new ones are scored in any case.
            old = held.where(F.col("batch") < number)
            changed = strongest_near(old, fresh, GK[2], back=LOOKBACK, reach=gk_radius(F.col("magnitude"))).select("event_id")
            again = held.where(F.col("batch") == number).unionByName(old.join(changed, "event_id", "left_semi"))
            past = catalogue.where(F.col("cell").isin(around(set(near)))).select("event_id", "ep", "lat", "lon", "magnitude")
            features(again, past).withColumn("score", self.score).write.mode("overwrite").parquet(at("scores"))
            scored = spark.read.parquet(at("scores")).count()
        work = [(number, fresh.count(), scored, len(touched), len(near))]
        spark.createDataFrame(work, "number long, n_new long, n_scored long, n_touched int, n_near int").coalesce(1).write.mode("overwrite").parquet(at("work"))

    @staticmethod
    def cells(events: DataFrame) -> set[int]:
        """At most 648 numbers."""
        return {r[0] for r in events.select("cell").distinct().collect()}

    def catalogue(self, spark: SparkSession, until: int) -> DataFrame:
        """The events of the batches before ``until``."""
        return spark.read.schema(f"{EVENTS}, batch long, cell int").parquet(f"{self.path}/catalogue").where(F.col("batch") < until) if until and self.has(spark, "catalogue") else spark.createDataFrame([], f"{EVENTS}, batch long, cell int")

    def has(self, spark: SparkSession, name: str) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    def table(self, spark: SparkSession) -> DataFrame:
        """The last score of each event of the time that the table keeps."""
        scores = spark.read.parquet(f"{self.path}/scores")
        last = scores.groupBy("event_id").agg(F.max_by(F.struct(*[c for c in scores.columns if c not in ("event_id", "batch")]), "batch").alias("s")).select("event_id", "s.*")
        return last.where(F.col("ep") > F.lit(self.catalogue(spark, 1 << 62).agg(F.max("ep")).first()[0] - KEEP))

    def work(self, spark: SparkSession) -> DataFrame:
        """number, n_new, n_scored, n_touched (cells) and n_near of each batch."""
        return spark.read.parquet(f"{self.path}/work").drop("batch")
