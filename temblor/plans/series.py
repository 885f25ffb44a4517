"""Windows over time: trailing counts, rolling statistics, resampling, anomalies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ordered import carried
from ..operators.trailing import trailing_extrema, trailing_sums
from ..sources.projection import DAY, QUAKES, SAMPLES, quakes, samples, table
from .registry import query

HOUR = 3600
ZONED = f"{QUAKES}, z AS (SELECT *, CAST(floor((lon + 180) / 30) AS BIGINT) AS zone, CAST(floor(ep) AS BIGINT) AS t FROM quakes)"
#: Hourly means of each metric.
HOURLY = f"{SAMPLES}, hourly AS (SELECT metric, CAST(floor(ep / 3600) AS BIGINT) AS hour, round(avg(value), 4) AS v FROM samples GROUP BY 1, 2)"
#: A daily signal of seven years.
DAILY = "daily AS (SELECT l_returnflag AS metric, CAST(floor(epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 86400e6) AS BIGINT) AS day, round(avg(l_quantity), 4) AS v FROM lineitem GROUP BY 1, 2)"


def zoned(spark, sf_dir):
    return quakes(spark, sf_dir).withColumns({"zone": F.floor((F.col("lon") + 180) / 30), "t": F.floor("ep")})


def hourly(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("metric", F.floor(F.col("ep") / 3600).alias("hour")).agg(F.round(F.avg("value"), 4).alias("v"))


def daily(spark, sf_dir):
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86400e6)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), day.alias("day")).agg(F.round(F.avg("l_quantity"), 4).alias("v"))


#: Amounts of earthquakes differ by many powers of ten; as decimals their sums are exact.
EXACT = "decimal(38,10)"


def over(name: str, seconds: int) -> str:
    return f"{name} AS (PARTITION BY zone ORDER BY t RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)"


@query(f"WITH {ZONED} SELECT event_id, count(*) OVER d1 AS n_1d, count(*) OVER d7 AS n_7d, count(*) FILTER (magnitude >= 4) OVER d7 AS n4_7d FROM z WINDOW {over('d1', 86400)}, {over('d7', 604800)}")
def sliding_counts(spark, sf_dir):
    s = trailing_sums(zoned(spark, sf_dir), [86400, 604800], {"n": F.lit(1), "n4": F.expr("magnitude >= 4").cast("int")})
    return s.select("event_id", F.col("n_86400").alias("n_1d"), F.col("n_604800").alias("n_7d"), F.col("n4_604800").alias("n4_7d"))


@query(f"WITH {ZONED} SELECT event_id, max(magnitude) OVER d1 AS top_1d, min(magnitude) OVER d1 AS low_1d, max(magnitude) OVER d7 AS top_7d FROM z WINDOW {over('d1', 86400)}, {over('d7', 604800)}")
def sliding_extrema(spark, sf_dir):
    e = trailing_extrema(zoned(spark, sf_dir), [86400, 604800], "magnitude")
    return e.select("event_id", F.col("high_86400").alias("top_1d"), F.col("low_86400").alias("low_1d"), F.col("high_604800").alias("top_7d"))


@query(f"WITH {ZONED} SELECT event_id, round(log10(sum(pow(10.0::DOUBLE, 1.5 * magnitude)) OVER d3 + 1), 5) AS energy, round(log10(sum(pow(10.0::DOUBLE, 1.5 * magnitude + 9.05)) OVER d3), 5) AS moment FROM z WINDOW {over('d3', 259200)}")
def energy_moment(spark, sf_dir):
    power = lambda plus: F.pow(F.lit(10.0), 1.5 * F.col("magnitude") + plus).cast(EXACT)
    s = trailing_sums(zoned(spark, sf_dir), [259200], {"energy": power(0), "moment": power(9.05)})
    return s.select("event_id", F.round(F.log10(F.col("energy_259200").cast("double") + 1), 5).alias("energy"), F.round(F.log10(F.col("moment_259200").cast("double")), 5).alias("moment"))


@query(f"WITH {ZONED}, w AS (SELECT event_id, count(*) OVER d7 AS n, avg(magnitude) OVER d7 AS mean FROM z WINDOW {over('d7', 604800)}) SELECT event_id, round(CASE WHEN n >= 15 AND mean > 2.51 THEN 0.4342944819 / (mean - 2.5) END, 5) AS b FROM w")
def b_value(spark, sf_dir):
    s = trailing_sums(zoned(spark, sf_dir), [604800], {"n": F.lit(1), "m": F.col("magnitude").cast(EXACT)})
    w = s.select("event_id", F.col("n_604800").alias("n"), (F.col("m_604800").cast("double") / F.col("n_604800")).alias("mean"))
    return w.select("event_id", F.round(F.when((F.col("n") >= 15) & (F.col("mean") > 2.51), 0.4342944819 / (F.col("mean") - 2.5)), 5).alias("b"))


@query(f"WITH {ZONED} SELECT event_id, round(avg(CASE WHEN depth_km > 0 THEN depth_km END) OVER d7, 5) AS mean_depth, round(avg(CASE WHEN depth_km > 70 THEN 1.0 ELSE 0.0 END) OVER d7, 5) AS deep FROM z WINDOW {over('d7', 604800)}")
def depth_fraction(spark, sf_dir):
    d = F.col("depth_km")
    s = trailing_sums(zoned(spark, sf_dir), [604800], {"n": F.lit(1), "known": (d > 0).cast("int"), "depth": F.when(d > 0, d).cast(EXACT), "deep": (d > 70).cast("int")})
    mean = F.when(F.col("known_604800") > 0, F.col("depth_604800").cast("double") / F.col("known_604800"))
    return s.select("event_id", F.round(mean, 5).alias("mean_depth"), F.round(F.col("deep_604800") / F.col("n_604800"), 5).alias("deep"))


@query(f"WITH {ZONED} SELECT event_id, round(coalesce((t - max(t) OVER (PARTITION BY zone ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 3600, 720), 5) AS hours FROM z")
def time_since_last(spark, sf_dir):
    z = zoned(spark, sf_dir).select("zone", "event_id", "t")
    # Seconds with events, each once: what is carried to a second is the one before it.
    seconds = carried(z.select("zone", "t").distinct(), ["zone"], ["t"], "t", F.floor(F.col("t") / DAY), "before", own=False)
    return z.join(seconds, ["zone", "t"]).select("event_id", F.round(F.coalesce((F.col("t") - F.col("before")) / 3600, F.lit(720.0)), 5).alias("hours"))


def rows_back(n: int, ahead: int = 0):
    return Window.partitionBy("metric").orderBy("day").rowsBetween(-n, ahead)


def day_rows(name: str, n: int, ahead: str = "CURRENT ROW") -> str:
    return f"{name} AS (PARTITION BY metric ORDER BY day ROWS BETWEEN {n} PRECEDING AND {ahead})"


@query(f"WITH {DAILY}, i AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day) AS k FROM daily) SELECT metric, day, round(CASE WHEN k < 7 THEN 0 ELSE regr_slope(v, k) OVER w END, 8) AS slope FROM i WINDOW {day_rows('w', 6)}")
def rolling_slope(spark, sf_dir):
    """Slope of the last seven values; its sums come from one frame."""
    k = F.row_number().over(Window.partitionBy("metric").orderBy("day"))
    d = daily(spark, sf_dir).withColumn("k", k)
    return d.select("metric", "day", F.round(F.when(F.col("k") < 7, 0.0).otherwise(F.regr_slope("v", "k").over(rows_back(6))), 8).alias("slope"))


@query(f"WITH {DAILY} SELECT metric, day, round(avg(v) OVER w, 8) AS mean, round(stddev_pop(v) OVER w, 8) AS std, max(v) OVER w AS top, round(max(v) OVER w - min(v) OVER w, 8) AS range FROM daily WINDOW {day_rows('w', 23)}")
def rolling_stats(spark, sf_dir):
    w = rows_back(23)
    return daily(spark, sf_dir).select("metric", "day", F.round(F.avg("v").over(w), 8).alias("mean"), F.round(F.stddev_pop("v").over(w), 8).alias("std"), F.max("v").over(w).alias("top"), F.round(F.max("v").over(w) - F.min("v").over(w), 8).alias("range"))


@query(f"WITH {DAILY} SELECT metric, day, round(quantile_cont(v, 0.1) OVER w, 8) AS p10, round(quantile_cont(v, 0.9) OVER w, 8) AS p90 FROM daily WINDOW {day_rows('w', 29)}")
def rolling_percentiles(spark, sf_dir):
    w = rows_back(29)
    return daily(spark, sf_dir).select("metric", "day", F.round(F.percentile("v", 0.1).over(w), 8).alias("p10"), F.round(F.percentile("v", 0.9).over(w), 8).alias("p90"))


@query(f"WITH {DAILY} SELECT metric, day, round(avg(CASE WHEN v >= 26 THEN 1.0 ELSE 0.0 END) OVER w, 5) AS share FROM daily WINDOW {day_rows('w', 13)}")
def rolling_fraction(spark, sf_dir):
    return daily(spark, sf_dir).select("metric", "day", F.round(F.avg(F.when(F.col("v") >= 26, 1.0).otherwise(0.0)).over(rows_back(13)), 5).alias("share"))


@query(f"WITH {DAILY} SELECT metric, day, round(CASE WHEN count(v) OVER w >= 6 THEN v - quantile_cont(v, 0.5) OVER w END, 8) AS detrended FROM daily WINDOW {day_rows('w', 24, '23 FOLLOWING')}")
def centred_median_detrend(spark, sf_dir):
    w = rows_back(24, 23)
    return daily(spark, sf_dir).select("metric", "day", F.round(F.when(F.count("v").over(w) >= 6, F.col("v") - F.percentile("v", 0.5).over(w)), 8).alias("detrended"))


@query(f"WITH {DAILY}, b AS (SELECT *, count(v) OVER w AS n, avg(v) OVER w AS mean, stddev_samp(v) OVER w AS std FROM daily WINDOW {day_rows('w', 168)}) SELECT metric, day, round(CASE WHEN n >= 24 AND std > 0 THEN (v - mean) / std END, 5) AS z, round(CASE WHEN n >= 24 AND std > 0 THEN least(greatest(-(v - mean) / std, 0), 5) END, 5) AS quiet FROM b")
def zscore_quiescence(spark, sf_dir):
    w = rows_back(168)
    b = daily(spark, sf_dir).select("metric", "day", "v", F.count("v").over(w).alias("n"), F.avg("v").over(w).alias("mean"), F.stddev_samp("v").over(w).alias("std"))
    z = F.when((F.col("n") >= 24) & (F.col("std") > 0), (F.col("v") - F.col("mean")) / F.col("std"))
    return b.select("metric", "day", F.round(z, 5).alias("z"), F.round(F.when(z.isNotNull(), F.least(F.greatest(-z, F.lit(0.0)), F.lit(5.0))), 5).alias("quiet"))


@query(f"WITH {HOURLY} SELECT metric, hour, round(v - quantile_cont(v, 0.5) OVER (PARTITION BY metric, hour % 24 ORDER BY hour ROWS BETWEEN 26 PRECEDING AND CURRENT ROW), 8) AS anomaly FROM hourly")
def diurnal_anomaly(spark, sf_dir):
    """Against the median of the same hour of the last 27 days."""
    w = Window.partitionBy("metric", F.col("hour") % 24).orderBy("hour").rowsBetween(-26, 0)
    return hourly(spark, sf_dir).select("metric", "hour", F.round(F.col("v") - F.percentile("v", 0.5).over(w), 8).alias("anomaly"))


@query(f"""WITH {HOURLY}, span AS (SELECT min(hour) AS a, max(hour) AS b FROM hourly), grid AS (SELECT metric, unnest(range(a, b + 1)) AS hour FROM (SELECT DISTINCT metric FROM hourly), span),
j AS (SELECT metric, hour, v FROM grid LEFT JOIN hourly USING (metric, hour)), f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY metric ORDER BY hour ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS filled FROM j) SELECT metric, hour, filled FROM f""")
def resample_hourly_ffill(spark, sf_dir):
    """Every hour of the span, gaps of up to six hours filled from before; the grid has a row for each key and hour and needs no join."""
    h = hourly(spark, sf_dir)
    span = h.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = h.select("metric").distinct().join(F.broadcast(span)).select("metric", F.explode(F.sequence("a", "b")).alias("hour"))
    w = Window.partitionBy("metric").orderBy("hour").rowsBetween(-6, 0)
    return grid.join(h, ["metric", "hour"], "left").select("metric", "hour", F.last("v", ignorenulls=True).over(w).alias("filled"))


@query(f"""WITH {HOURLY}, n AS (SELECT metric, hour, v, lead(hour) OVER w AS h1, lead(v) OVER w AS v1 FROM hourly WINDOW w AS (PARTITION BY metric ORDER BY hour))
SELECT metric, k AS hour, round(v + (v1 - v) * (k - hour) / greatest(coalesce(h1, hour + 1) - hour, 1), 8) AS v FROM (SELECT *, unnest(range(hour, CASE WHEN h1 - hour <= 6 THEN h1 ELSE hour + 1 END)) AS k FROM n) WHERE v1 IS NOT NULL""")
def interpolate_gap(spark, sf_dir):
    """Straight lines over gaps of up to six hours."""
    w = Window.partitionBy("metric").orderBy("hour")
    n = hourly(spark, sf_dir).withColumns({"h1": F.lead("hour").over(w), "v1": F.lead("v").over(w)}).where("v1 is not null")
    n = n.withColumn("k", F.explode(F.sequence("hour", F.when(F.col("h1") - F.col("hour") <= 6, F.col("h1") - 1).otherwise(F.col("hour")))))
    return n.select("metric", F.col("k").alias("hour"), F.round(F.expr("v + (v1 - v) * (k - hour) / greatest(h1 - hour, 1)"), 8).alias("v"))


@query(f"""WITH {ZONED}, m AS (SELECT max(t) AS now FROM z), b AS (SELECT zone, (now - t) // 21600 AS bin, count(*) AS n FROM z, m WHERE now - t < 120 * 21600 GROUP BY 1, 2),
g AS (SELECT zone, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT zone FROM z) CROSS JOIN (SELECT range AS bin FROM range(120)) LEFT JOIN b USING (zone, bin)),
s AS (SELECT zone, max(CASE WHEN bin = 0 THEN n END) AS latest, avg(CASE WHEN bin > 0 THEN n END) AS mean, var_pop(CASE WHEN bin > 0 THEN n END) AS var FROM g GROUP BY zone)
SELECT zone, latest, round((latest - mean) / CASE WHEN var = 0 THEN greatest(1, 0.5 * mean) ELSE sqrt(var) END, 5) AS z FROM s""")
def rate_bins_zscore(spark, sf_dir):
    """Six-hour bins by age: the latest against the 119 before, empty bins included by arithmetic instead of a grid."""
    z = zoned(spark, sf_dir)
    now = F.broadcast(z.agg(F.max("t").alias("now")))
    b = z.join(now).withColumn("bin", F.floor((F.col("now") - F.col("t")) / 21600)).groupBy("zone", "bin").count()
    old = F.when((F.col("bin") > 0) & (F.col("bin") < 120), F.col("count")).otherwise(0)
    s = b.groupBy("zone").agg(F.coalesce(F.max(F.when(F.col("bin") == 0, F.col("count"))), F.lit(0)).alias("latest"), (F.sum(old) / 119).alias("mean"), (F.sum(old * old) / 119).alias("square"))
    var = F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return s.select("zone", "latest", F.round((F.col("latest") - F.col("mean")) / F.when(var < 1e-12, F.greatest(F.lit(1.0), 0.5 * F.col("mean"))).otherwise(F.sqrt(var)), 5).alias("z"))


@query(f"""WITH {HOURLY}, n AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY hour) AS k, count(*) OVER (PARTITION BY metric) AS c, abs(v - lag(v) OVER (PARTITION BY metric ORDER BY hour)) AS dv FROM hourly)
SELECT metric, round(var_pop(v) FILTER (3 * k > 2 * c) / var_pop(v) FILTER (3 * k <= 2 * c), 5) AS variance_ratio, round(avg(dv) FILTER (3 * k > 2 * c) / avg(dv) FILTER (3 * k <= 2 * c), 5) AS change_ratio FROM n GROUP BY metric""")
def recent_third_ratios(spark, sf_dir):
    """The last third against the rest: variance, and mean absolute change."""
    w = Window.partitionBy("metric").orderBy("hour")
    h = hourly(spark, sf_dir)
    n = h.withColumns({"k": F.row_number().over(w), "dv": F.abs(F.col("v") - F.lag("v").over(w))}).join(F.broadcast(h.groupBy("metric").agg(F.count("*").alias("c"))), "metric")
    late = 3 * F.col("k") > 2 * F.col("c")
    pick = lambda c, on: F.when(on, F.col(c))
    return n.groupBy("metric").agg(F.round(F.var_pop(pick("v", late)) / F.var_pop(pick("v", ~late)), 5).alias("variance_ratio"), F.round(F.avg(pick("dv", late)) / F.avg(pick("dv", ~late)), 5).alias("change_ratio"))


@query(f"""WITH {SAMPLES}, f AS (SELECT metric, CAST(floor(ep / 300) AS BIGINT) AS bin, min(value) AS low, max(value) AS top, round(avg(value), 6) AS mean, count(*) AS n FROM samples GROUP BY 1, 2) SELECT * FROM f""")
def five_minute_bins(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("metric", F.floor(F.col("ep") / 300).alias("bin")).agg(F.min("value").alias("low"), F.max("value").alias("top"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query(f"""WITH {ZONED}, {SAMPLES}, e AS (SELECT event_id, t FROM z WHERE magnitude >= 5), s AS (SELECT CAST(floor(ep) AS BIGINT) AS t, value FROM samples WHERE metric = 'view')
SELECT e.event_id, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, min(value) AS low, max(value) AS top FROM e JOIN s ON s.t >= e.t - 86400 AND s.t < e.t GROUP BY e.event_id""")
def event_signal_windows(spark, sf_dir):
    """A signal's statistics over the day before each event: an equi-join on day buckets, then the exact range."""
    e = zoned(spark, sf_dir).where("magnitude >= 5").select("event_id", "t").withColumn("bucket", F.explode(F.array(F.floor(F.col("t") / 86400), F.floor(F.col("t") / 86400) - 1)))
    s = samples(spark, sf_dir).where("metric = 'view'").select(F.floor("ep").alias("st"), "value").withColumn("bucket", F.floor(F.col("st") / 86400))
    j = e.join(s, "bucket").where("st >= t - 86400 and st < t")
    return j.groupBy("event_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("std"), F.min("value").alias("low"), F.max("value").alias("top"))
