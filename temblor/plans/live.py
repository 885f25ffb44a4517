"""Streams run to their end, feeds, sinks, clusters and a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import GK, gk_radius
from ..operators import cluster
from ..operators.around import tallies
from ..operators.graph import checkpointed
from ..sources import feeds, sinks
from ..sources.projection import DAY, QUAKES, SAMPLES, quakes, samples
from ..streaming import live
from .registry import query
from .series import ZONED


@query(f"WITH {ZONED} SELECT zone, CAST(floor(ep / 3600) AS BIGINT) AS hour, count(*) AS n, max(magnitude) AS top FROM z GROUP BY 1, 2")
def stream_hourly_counts(spark, sf_dir):
    return live.finished(live.hourly_counts(live.events_stream(spark, sf_dir)), "complete", "hourly")


@query(f"WITH {ZONED} SELECT event_id, magnitude, zone FROM z")
def stream_first_reports(spark, sf_dir):
    return live.finished(live.first_reports(live.events_stream(spark, sf_dir)).drop("time"), "append", "reports")


@query(f"""WITH RECURSIVE {ZONED}, l AS (SELECT zone, ep AS t, level, lag(level) OVER w AS was, row_number() OVER w AS k FROM (SELECT *, {" + ".join(f"CAST(magnitude >= {x} AS BIGINT)" for x in live.LEVELS)} AS level FROM z) WINDOW w AS (PARTITION BY zone ORDER BY ep, event_id)),
c AS (SELECT * FROM l WHERE level > was AND level >= 2), n AS (SELECT a.zone, a.k, min(b.k) AS nk FROM c a JOIN c b ON b.zone = a.zone AND b.t - a.t >= {live.COOLDOWN} GROUP BY 1, 2),
s AS (SELECT zone, min(k) AS k FROM c GROUP BY 1 UNION ALL SELECT n.zone, nk FROM s JOIN n USING (zone, k)) SELECT zone, t, level FROM s JOIN c USING (zone, k)""")
def stream_alerts(spark, sf_dir):
    """Rises of a zone's level, with a pause after each alert."""
    return live.finished(live.alerts(live.events_stream(spark, sf_dir)), "append", "alerts")


@query(f"WITH {QUAKES} SELECT id, round(ep * 1000) / 1000.0::DOUBLE AS ep, magnitude, depth_km, lat, lon FROM quakes WHERE event_id % 3 <> 0")
def feed_geojson(spark, sf_dir):
    """Quakes written as feature collections with times in milliseconds, a third of them without magnitude, and parsed again."""
    q = quakes(spark, sf_dir)
    feature = F.struct("id", F.struct(F.when(F.col("event_id") % 3 != 0, F.col("magnitude")).alias("mag"), F.round(F.col("ep") * 1000).cast("long").alias("time"), F.lit("x").alias("place")).alias("properties"), F.struct(F.array("lon", "lat", "depth_km").alias("coordinates")).alias("geometry"))
    text = q.groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("text"))
    return feeds.geojson_quakes(text).select("id", "ep", "magnitude", "depth_km", "lat", "lon")


@query(f"""WITH {QUAKES} SELECT 'emsc_' || CASE event_id % 4 WHEN 0 THEN 'u' || event_id WHEN 1 THEN id ELSE CAST(event_id AS VARCHAR) END AS id, ep, magnitude, depth_km, lat, lon,
  CASE WHEN event_id % 2 = 0 THEN 'north' ELSE 'south' END AS place FROM quakes WHERE event_id % 5 <> 0""")
def feed_agency(spark, sf_dir):
    """Quakes written as another agency's collections: ISO times, ids and places in one of several fields, a fifth without magnitude; parsed again."""
    q = quakes(spark, sf_dir)
    k = F.col("event_id")
    time = F.date_format(F.timestamp_micros(F.round(F.col("ep") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    properties = F.struct(
        F.when(k % 5 != 0, F.col("magnitude")).alias("mag"), time.alias("time"), F.when(k % 4 >= 2, k.cast("string")).otherwise("").alias("source_id"), F.when(k % 4 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("unid"),
        F.when(k % 2 == 0, "north").otherwise("").alias("flynn_region"), F.lit("south").alias("region"),
    )
    feature = F.struct("id", properties.alias("properties"), F.struct(F.array("lon", "lat", "depth_km").alias("coordinates")).alias("geometry"))
    text = q.groupBy(F.floor(k / 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("text"))
    return feeds.agency_quakes(text)

@query(f"""WITH {SAMPLES} SELECT event_id, 'kp_index' AS metric, floor(ep) AS ep, round(value / 55, 3) AS value FROM samples UNION ALL SELECT event_id, 'dst_index', floor(ep), -round(value / 5, 1) FROM samples WHERE event_id % 7 <> 0""")
def feed_tagged(spark, sf_dir):
    """Samples written as arrays of tagged objects, some without the second value, and parsed again; each sample is a feed."""
    s = samples(spark, sf_dir)
    tag = F.date_format(F.timestamp_seconds(F.floor("ep")), "yyyy-MM-dd'T'HH:mm:ss")
    entry = F.struct(tag.alias("time_tag"), F.round(F.col("value") / 55, 3).alias("kp_index"), F.when(F.col("event_id") % 7 != 0, -F.round(F.col("value") / 5, 1)).alias("dst"))
    text = s.groupBy("event_id").agg(F.to_json(F.collect_list(entry)).alias("text"))
    narrow = feeds.tagged(text.withColumnRenamed("event_id", "feed"), {"kp_index": "kp_index", "dst": "dst_index"}, keep=["feed"])
    return narrow.select(F.col("feed").alias("event_id"), "metric", F.unix_seconds("time").cast("double").alias("ep"), "value")


@query(f"WITH {QUAKES}, k AS (SELECT CAST(floor(ep / 600) AS BIGINT) AS key, magnitude FROM quakes) SELECT key, count(*) AS n FROM k WHERE magnitude < 4 AND key NOT IN (SELECT key FROM k WHERE magnitude >= 4) GROUP BY 1")
def insert_or_ignore(spark, sf_dir):
    """Weak events by slots of ten minutes, but for the slots that strong events already hold."""
    q = quakes(spark, sf_dir).withColumn("key", F.floor(F.col("ep") / 600))
    fresh = q.where("magnitude < 4")
    new = sinks.only_new(fresh.select("key"), q.where("magnitude >= 4").select("key"), ["key"])
    return fresh.join(new, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))


@query()
def swarm_clusters(spark, sf_dir):
    """Density clusters of 150 km and three events, of magnitudes 2.5 to 5 within the last 72 hours, with size, centre, span and strongest event."""
    q = quakes(spark, sf_dir).where("magnitude >= 2.5 and magnitude < 5").select("event_id", "ep", "lat", "lon", "magnitude")
    q = q.join(F.broadcast(q.agg(F.max("ep").alias("now")))).where(F.col("ep") > F.col("now") - 3 * DAY).drop("now")
    c = cluster.density_clusters(q.drop("magnitude"), km=150.0, seconds=3 * DAY, least=3)
    return q.join(c, "event_id").groupBy("cluster").agg(F.count("*").alias("n"), F.max("magnitude").alias("top"), F.round(F.avg("lat"), 4).alias("lat"), F.round(F.avg("lon"), 4).alias("lon"), F.round((F.max("ep") - F.min("ep")) / 3600, 3).alias("hours"))


def reaches(q):
    """q with the km and seconds within which an event claims weaker ones, which both grow with its magnitude, up to 200 km and 1,100 days."""
    m = F.col("magnitude")
    days = F.when(m >= 6.5, F.pow(F.lit(10.0), 0.032 * m + 2.7389)).otherwise(F.pow(F.lit(10.0), 0.5409 * m - 0.547))
    return q.withColumns({"km": F.least(F.pow(F.lit(10.0), 0.1238 * m + 0.983), F.lit(200.0)), "seconds": F.least(days, F.lit(1100.0)) * DAY})


@query()
def decluster(spark, sf_dir):
    q = quakes(spark, sf_dir).select("event_id", "ep", "lat", "lon", "magnitude")
    return cluster.strongest_first(reaches(q).withColumn("turn", F.lit(0).cast("long")).withColumnRenamed("magnitude", "strength"))


@query()
def event_model(spark, sf_dir):
    """Escalation probability by logistic regression on the lookback features, trained on the first 70 % of time; calibration by band on the rest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    q = quakes(spark, sf_dir).select("event_id", "ep", "lat", "lon", "magnitude")
    names = ["n1", "n7", "top", "mean", "since", "magnitude"]
    x = tallies(q, q, GK[2], (DAY, 7 * DAY, 30 * DAY), 7 * DAY, gk_radius(F.col("magnitude")))
    x = x.select("ep", F.col("n0").alias("n1"), F.col("n1").alias("n7"), "top", "mean", "since", "magnitude", (F.col("after") >= F.col("magnitude") + 1).cast("double").alias("label"))
    # Stored, since the model goes over its rows many times.
    rows = checkpointed(x.na.fill(0.0, ["n1", "n7", "top", "mean", "since", "label"]))
    bounds = q.agg(F.min("ep").alias("a"), F.max("ep").alias("b")).first()
    cut = bounds["a"] + 0.7 * (bounds["b"] - bounds["a"])
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), LogisticRegression(maxIter=20)]).fit(rows.where(F.col("ep") <= cut - 7 * DAY))
    scored = model.transform(rows.where(F.col("ep") > cut)).withColumn("p", vector_to_array("probability")[1])
    return scored.groupBy(F.floor(F.col("p") * 10).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("label"), 6).alias("realized"))

