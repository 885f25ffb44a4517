"""Catalog queries: filters, counts, latest values, de-duplication by rank."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ordered import carried, numbered
from ..sources.projection import DAY, QUAKES, SAMPLES, quakes, samples, table
from .registry import query

FIRST, LAST = 1704067200.0, 1704067200.0 + 30 * 86400


@query(f"WITH {QUAKES} SELECT id, ep, magnitude, lat, lon FROM quakes WHERE magnitude >= 4.0 AND ep >= {FIRST + 5 * 86400} ORDER BY ep DESC, id LIMIT 100")
def catalog_filter_topk(spark, sf_dir):
    """Newest-first listing by time and least magnitude."""
    q = quakes(spark, sf_dir).where((F.col("magnitude") >= 4.0) & (F.col("ep") >= FIRST + 5 * 86400))
    return q.select("id", "ep", "magnitude", "lat", "lon").orderBy(F.desc("ep"), "id").limit(100)


@query(f"WITH {SAMPLES} SELECT source, count(*) AS n, min(ep) AS first_ep, max(ep) AS last_ep, round(avg(value), 6) AS mean FROM samples GROUP BY source")
def catalog_stats(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.min("ep").alias("first_ep"), F.max("ep").alias("last_ep"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"""WITH {QUAKES}, m AS (SELECT max(ep) AS now FROM quakes)
SELECT count(*) AS n, count(*) FILTER (magnitude >= 4.5) AS n45, count(*) FILTER (magnitude >= 5) AS n5, max(magnitude) AS top FROM quakes, m WHERE ep >= now - 86400""")
def summary_24h(spark, sf_dir):
    """The last day up to the newest event."""
    q = quakes(spark, sf_dir)
    now = q.agg(F.max("ep").alias("now"))
    return q.join(F.broadcast(now)).where("ep >= now - 86400").agg(F.count("*").alias("n"), F.count_if(F.expr("magnitude >= 4.5")).alias("n45"), F.count_if(F.expr("magnitude >= 5")).alias("n5"), F.max("magnitude").alias("top"))


@query(f"WITH {QUAKES} SELECT CAST(floor(ep / 3600) AS BIGINT) AS hour, count(*) AS n, max(magnitude) AS top FROM quakes GROUP BY 1")
def hourly_histogram(spark, sf_dir):
    return quakes(spark, sf_dir).groupBy(F.floor(F.col("ep") / 3600).alias("hour")).agg(F.count("*").alias("n"), F.max("magnitude").alias("top"))


@query(f"""WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ep, event_id) AS k, greatest(1, count(*) OVER (PARTITION BY metric) // 100) AS step FROM samples)
SELECT metric, event_id, ep, value FROM n WHERE (k - 1) % step = 0""")
def downsample_modulo(spark, sf_dir):
    """Every step-th sample of a metric, for about 100 points."""
    s = samples(spark, sf_dir)
    # The step comes from a small aggregate; places come from counts by day, so that a metric is not one task.
    step = s.groupBy("metric").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 100)).alias("step"))
    return numbered(s, ["metric"], ["ep", "event_id"], F.floor(F.col("ep") / DAY)).join(F.broadcast(step), "metric").where("k % step = 0").select("metric", "event_id", "ep", "value")


@query(f"""WITH {SAMPLES}, n AS (SELECT metric, event_id, ep, floor(value / 50) AS level, lag(floor(value / 50)) OVER (PARTITION BY metric ORDER BY ep, event_id) AS before FROM samples)
SELECT metric, event_id, ep, CAST(level AS BIGINT) AS level FROM n WHERE level IS DISTINCT FROM before""")
def dedup_consecutive(spark, sf_dir):
    """Only samples at which the level changes."""
    s = samples(spark, sf_dir).select("metric", "event_id", "ep", F.floor(F.col("value") / 50).alias("level"))
    s = carried(s, ["metric"], ["ep", "event_id"], "level", F.floor(F.col("ep") / DAY), "before", own=False)
    return s.where(~F.col("level").eqNullSafe(F.col("before"))).drop("before")


@query(f"""WITH {SAMPLES}, w AS (SELECT * FROM (VALUES ('view', 0.0, 400.0), ('click', 1.0, 300.0), ('purchase', 5.0, 250.0)) AS t(metric, lo, hi))
SELECT s.metric, count(*) AS n, round(avg(value), 6) AS mean FROM samples s JOIN w ON s.metric = w.metric AND value BETWEEN lo AND hi GROUP BY s.metric""")
def validity_filter(spark, sf_dir):
    """Values inside their metric's valid range; the rules are a small table."""
    rules = spark.createDataFrame([("view", 0.0, 400.0), ("click", 1.0, 300.0), ("purchase", 5.0, 250.0)], "metric string, lo double, hi double")
    s = samples(spark, sf_dir).join(F.broadcast(rules), "metric").where("value between lo and hi")
    return s.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {SAMPLES}, w AS (SELECT * FROM (VALUES ('view'), ('none'), ('error')) AS t(metric)) SELECT metric FROM w WHERE EXISTS (SELECT 1 FROM samples s WHERE s.metric = w.metric)")
def available_signals(spark, sf_dir):
    wanted = spark.createDataFrame([("view",), ("none",), ("error",)], "metric string")
    return wanted.join(samples(spark, sf_dir).select("metric").distinct(), "metric", "left_semi")


@query("""SELECT s_suppkey AS station, count(l_orderkey) AS n, CAST(coalesce(sum(CASE WHEN l_linenumber IN (2, 3) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_event
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity >= 45 GROUP BY s_suppkey""")
def readings_summary_left_join(spark, sf_dir):
    """Stations with the number of their readings and of those in an event mode; stations without readings too."""
    r = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber").isin(2, 3)).alias("n_event"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"))
    return s.join(r, s.station == r.l_suppkey, "left").select("station", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_event", F.lit(0)).alias("n_event"))


@query("""SELECT s_suppkey AS volcano, s_name AS name, count(*) AS n, max(l_extendedprice) AS top FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE l_shipdate >= DATE '1998-01-01' AND l_discount <= 0.05 GROUP BY s_suppkey, s_name HAVING max(l_extendedprice) >= 40000""")
def hot_dim_having(spark, sf_dir):
    """Recent anomalies near a volcano, grouped, kept above a peak."""
    f = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("date")) & (F.col("l_discount") <= 0.05))
    f = f.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("top")).where("top >= 40000")
    return f.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("volcano"), F.col("s_name").alias("name"), "n", "top")


@query("""SELECT c_custkey AS key FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000""")
def active_union(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("key")).union(c.where("c_acctbal > 9000").select("c_custkey")).distinct()


@query(f"WITH {QUAKES} SELECT id, magnitude FROM quakes WHERE magnitude >= 4 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = event_id)")
def unanalysed_anti(spark, sf_dir):
    q = quakes(spark, sf_dir).where("magnitude >= 4")
    return q.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id")), "event_id", "left_anti").select("id", "magnitude")


@query(f"WITH {SAMPLES} SELECT metric, max(ep) AS ep, arg_max(value, ep) AS value FROM samples GROUP BY metric")
def latest_per_key(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("metric").agg(F.max("ep").alias("ep"), F.max_by("value", "ep").alias("value"))


@query(f"WITH {QUAKES} SELECT event_id % 1000 AS key, arg_max(id, ep) AS id, max(ep) AS ep FROM quakes GROUP BY 1")
def keep_last_by_id(spark, sf_dir):
    return quakes(spark, sf_dir).groupBy((F.col("event_id") % 1000).alias("key")).agg(F.max_by("id", "ep").alias("id"), F.max("ep").alias("ep"))


@query(f"""WITH {QUAKES}, r AS (SELECT *, event_id // 7 AS grp, CASE WHEN id LIKE 'us%' THEN 0 WHEN id LIKE 'emsc%' THEN 2 ELSE 1 END AS rank FROM quakes)
SELECT grp, id, magnitude FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank, magnitude DESC, event_id) AS k FROM r) WHERE k = 1""")
def prefer_rank_dedup(spark, sf_dir):
    """Of each group the report of the preferred agency."""
    q = quakes(spark, sf_dir).withColumn("grp", F.floor(F.col("event_id") / 7))
    rank = F.when(F.col("id").startswith("us"), 0).when(F.col("id").startswith("emsc"), 2).otherwise(1)
    best = q.groupBy("grp").agg(F.min(F.struct(rank.alias("a"), (-F.col("magnitude")).alias("b"), "event_id", "id")).alias("m"))
    return best.select("grp", "m.id", (-F.col("m.b")).alias("magnitude"))


@query("""SELECT l_suppkey AS station, count(DISTINCT l_shipdate) AS days, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_suppkey""")
def station_coverage(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("station")).agg(F.count_distinct("l_shipdate").alias("days"), F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query(f"WITH {QUAKES} SELECT id, lat, lon FROM quakes WHERE lat BETWEEN -20 AND 20 AND (lon >= 165 OR lon <= -170)")
def antimeridian_box(spark, sf_dir):
    """A box of longitudes that crosses the antimeridian."""
    lo, hi = 165.0, -170.0
    inside = F.col("lon").between(lo, hi) if lo <= hi else (F.col("lon") >= lo) | (F.col("lon") <= hi)
    return quakes(spark, sf_dir).where(F.col("lat").between(-20, 20) & inside).select("id", "lat", "lon")


@query("""SELECT year(l_shipdate) AS year, l_returnflag AS metric, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem
WHERE substr(CAST(l_shipdate AS VARCHAR), 1, 4) >= '1995' GROUP BY GROUPING SETS ((year(l_shipdate), l_returnflag), (l_returnflag), ())""")
def yearly_rollup(spark, sf_dir):
    """Counts by year and metric with subtotals, in one pass."""
    t = table(spark, sf_dir, "lineitem").where("l_shipdate >= date '1995-01-01'").select(F.year("l_shipdate").cast("long").alias("year"), F.col("l_returnflag").alias("metric"), "l_quantity")
    return t.groupingSets([["year", "metric"], ["metric"], []], "year", "metric").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("""SELECT CAST(l_shipdate AS DATE)::VARCHAR AS day, max(CASE WHEN l_returnflag = 'A' THEN n END) AS a, max(CASE WHEN l_returnflag = 'N' THEN n END) AS n, max(CASE WHEN l_returnflag = 'R' THEN n END) AS r
FROM (SELECT l_shipdate, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def pivot_daily(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").cast("string").alias("day")).pivot("l_returnflag", ["A", "N", "R"]).count()
    return t.select("day", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))
