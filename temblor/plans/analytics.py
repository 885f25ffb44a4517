"""Zone statistics, forecasts and their verification, scores, tests of significance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.graph import checkpointed
from ..operators.ordered import numbered
from ..operators.trailing import windows_ahead
from ..sources.projection import DAY, QUAKES, SAMPLES, samples, table
from .registry import query
from .series import HOURLY, ZONED, hourly, zoned

#: Forecasts from the orders: zone, window of 24, 48 or 72 h, probability.
FORECASTS = """forecasts AS (SELECT o_orderkey AS fid, o_orderkey % 12 AS zone, 24 * (1 + o_orderkey % 3) AS hours, 1704067200 + (o_orderkey * 9973) % 2592000 AS issued, ((o_orderkey * 37) % 100) / 100.0::DOUBLE AS p FROM orders)"""
RESOLVED = f"""{ZONED}, {FORECASTS}, hits AS (SELECT fid, max(magnitude) AS actual, min(t) AS first_t FROM forecasts JOIN (SELECT * FROM z WHERE magnitude >= 4) e ON e.zone = forecasts.zone AND e.t BETWEEN issued AND issued + hours * 3600 GROUP BY fid),
resolved AS (SELECT f.*, actual, CASE WHEN actual IS NULL THEN 'false_alarm' ELSE 'hit' END AS outcome, round((first_t - issued) / 3600, 1) AS lead_hours FROM forecasts f LEFT JOIN hits USING (fid))"""


#: Keys of a block in which forecasts of one score are ranked.
EDGE_BLOCK = 1_000_000


def forecasts(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("fid"), (k % 12).alias("zone"), (24 * (1 + k % 3)).alias("hours"), (1704067200 + (k * 9973) % 2592000).alias("issued"), (((k * 37) % 100) / 100.0).alias("p"))


def resolved(spark, sf_dir, of=None):
    """Forecasts, all or those given, with the strongest and the first event of their zone and window."""
    f = (forecasts(spark, sf_dir) if of is None else of).select("fid", "zone", "issued", "p", (F.col("hours") * 3600).alias("span"))
    r = windows_ahead(f, zoned(spark, sf_dir).where("magnitude >= 4").select("zone", "t", "magnitude"), ["zone"], F.col("issued"), "magnitude")
    outcome = F.when(F.col("first").isNull(), "false_alarm").otherwise("hit")
    return r.select("fid", "zone", F.expr("span div 3600").alias("hours"), "issued", "p", F.col("most").alias("actual"), outcome.alias("outcome"), F.round((F.col("first") - F.col("issued")) / 3600, 1).alias("lead_hours"))


@query(f"WITH {RESOLVED} SELECT fid, outcome, actual, lead_hours FROM resolved")
def forecast_resolve(spark, sf_dir):
    return resolved(spark, sf_dir).select("fid", "outcome", "actual", "lead_hours")


@query(f"WITH {RESOLVED} SELECT hours, count(*) AS n, count(*) FILTER (outcome = 'hit') AS hits, round(count(*) FILTER (outcome = 'hit') / count(*), 6) AS hit_rate, round(avg(lead_hours), 3) AS lead FROM resolved GROUP BY GROUPING SETS ((hours), ())")
def forecast_metrics(spark, sf_dir):
    """By window, and over all (hours null), from sums by window."""
    lead, whole = F.col("lead_hours"), lambda c: F.sum(c).alias(c)
    by = resolved(spark, sf_dir).groupBy("hours").agg(F.count("*").alias("n"), F.count_if(F.expr("outcome = 'hit'")).alias("hits"), F.sum(lead).alias("leads"), F.count(lead).alias("led"))
    r = by.groupingSets([["hours"], []], "hours").agg(whole("n"), whole("hits"), whole("leads"), whole("led"))
    return r.select("hours", "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("hit_rate"), F.round(F.col("leads") / F.nullif("led", F.lit(0)), 3).alias("lead"))


@query(f"WITH {RESOLVED} SELECT CASE WHEN p < 0.1 THEN '0-10' WHEN p < 0.3 THEN '10-30' WHEN p < 0.5 THEN '30-50' ELSE '50+' END AS band, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(CASE WHEN outcome = 'hit' THEN 1.0 ELSE 0.0 END), 6) AS realized FROM resolved GROUP BY 1")
def calibration_bands(spark, sf_dir):
    p = F.col("p")
    band = F.when(p < 0.1, "0-10").when(p < 0.3, "10-30").when(p < 0.5, "30-50").otherwise("50+")
    return resolved(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg(F.when(F.col("outcome") == "hit", 1.0).otherwise(0.0)), 6).alias("realized"))


@query(f"""WITH {RESOLVED}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, fid) AS k, count(*) OVER () AS n FROM resolved), f AS (SELECT * FROM (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) AS t(frac))
SELECT frac, round(avg(CASE WHEN outcome = 'hit' THEN 1.0 ELSE 0.0 END), 6) AS precision FROM r, f WHERE k <= greatest(1, floor(n * frac)) GROUP BY frac""")
def precision_at_k(spark, sf_dir):
    """Precision of the top shares.  Scores are counted by value first; only forecasts down to the last boundary score are resolved, and only those of a boundary score are ranked."""
    f = forecasts(spark, sf_dir)
    by = f.groupBy("p").agg(F.count("*").alias("c"))
    w = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({"c0": F.coalesce(F.sum("c").over(w), F.lit(0)), "n": F.sum("c").over(Window.partitionBy())})
    cut = by.withColumn("frac", F.explode(F.array(F.lit(0.01), F.lit(0.05), F.lit(0.1)))).withColumn("top", F.greatest(F.lit(1), F.floor(F.col("n") * F.col("frac"))))
    cut = checkpointed(cut.where("c0 < top and top <= c0 + c").select(F.col("p").alias("edge"), "frac", "top", "c0"))
    first = f.join(F.broadcast(cut.agg(F.min("edge").alias("edge"))), F.col("p") >= F.col("edge")).drop("edge")
    r = checkpointed(resolved(spark, sf_dir, first).select("fid", "p", (F.col("outcome") == "hit").cast("long").alias("y"))).join(F.broadcast(cut), F.col("p") >= F.col("edge"))
    # Places among the equal scores come from blocks of the fid, so that no task ranks all of them.
    edge = numbered(r.where("p = edge"), ["frac"], ["fid"], F.floor(F.col("fid") / EDGE_BLOCK), "k").where("k < top - c0")
    return r.where("p > edge").select("frac", "top", "y").unionByName(edge.select("frac", "top", "y")).groupBy("frac").agg(F.round(F.sum("y") / F.max("top"), 6).alias("precision"))


@query(f"""WITH {RESOLVED}, r AS (SELECT zone, CAST(outcome = 'hit' AS INT) AS y, rank() OVER (PARTITION BY zone ORDER BY p) + (count(*) OVER (PARTITION BY zone, p) - 1) / 2 AS mid FROM resolved)
SELECT zone, round((sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r GROUP BY zone HAVING sum(y) BETWEEN 1 AND count(*) - 1""")
def auc_by_zone(spark, sf_dir):
    """Area under the curve by mid-ranks, from counts by score."""
    by = resolved(spark, sf_dir).groupBy("zone", "p").agg(F.count("*").alias("c"), F.count_if(F.expr("outcome = 'hit'")).alias("y"))
    w = Window.partitionBy("zone").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    mid = F.coalesce(F.sum("c").over(w), F.lit(0)) + (F.col("c") + 1) / 2
    r = by.withColumn("ranks", F.col("y") * mid).groupBy("zone").agg(F.sum("ranks").alias("r"), F.sum("y").alias("y"), F.sum("c").alias("n")).where("y > 0 and y < n")
    return r.select("zone", F.round(F.expr("(r - y * (y + 1) / 2) / (y * (n - y))"), 6).alias("auc"))


@query(f"WITH {ZONED} SELECT zone, count(*) AS n, round(median(magnitude), 6) AS med, round(quantile_cont(magnitude, 0.75), 6) AS p75, round(quantile_cont(magnitude, 0.9), 6) AS p90, max(magnitude) AS top, round(stddev_pop(magnitude), 6) AS std FROM z WHERE magnitude >= 3 GROUP BY zone")
def zone_mag_stats(spark, sf_dir):
    z = zoned(spark, sf_dir).where("magnitude >= 3")
    p = lambda q: F.round(F.percentile("magnitude", q), 6)
    return z.groupBy("zone").agg(F.count("*").alias("n"), p(0.5).alias("med"), p(0.75).alias("p75"), p(0.9).alias("p90"), F.max("magnitude").alias("top"), F.round(F.stddev_pop("magnitude"), 6).alias("std"))


PHASE = "2 * pi() * (t % 44712) / 44712.0::DOUBLE"


@query(f"""WITH {ZONED}, s AS (SELECT zone, count(*) AS n, sqrt(pow(sum(cos({PHASE})), 2) + pow(sum(sin({PHASE})), 2)) AS d FROM z GROUP BY zone)
SELECT zone, n, round(CASE WHEN n < 10 THEN 0 ELSE d / n END, 6) AS r, round(CASE WHEN n < 10 THEN 1 ELSE exp(-d * d / n) END, 6) AS p FROM s""")
def schuster_by_zone(spark, sf_dir):
    """Schuster's test of the tidal phases of a zone's events."""
    phase = 2 * F.pi() * (F.col("t") % 44712) / 44712.0
    s = zoned(spark, sf_dir).groupBy("zone").agg(F.count("*").alias("n"), F.sqrt(F.pow(F.sum(F.cos(phase)), 2) + F.pow(F.sum(F.sin(phase)), 2)).alias("d"))
    few = F.col("n") < 10
    return s.select("zone", "n", F.round(F.when(few, 0.0).otherwise(F.col("d") / F.col("n")), 6).alias("r"), F.round(F.when(few, 1.0).otherwise(F.exp(-F.col("d") * F.col("d") / F.col("n"))), 6).alias("p"))


HOURS = f"{HOURLY}, q AS (SELECT CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) AS hour, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1), s AS (SELECT hour, v FROM hourly WHERE metric = 'view')"


def hour_counts(spark, sf_dir):
    return samples(spark, sf_dir).where("metric <> 'view'").groupBy(F.floor(F.col("ep") / 3600).alias("hour")).agg(F.count("*").alias("n"))


@query(f"WITH {HOURS}, l AS (SELECT range - 24 AS lag FROM range(49)) SELECT lag, count(*) AS n, round(corr(v, q.n), 5) AS r FROM l, q JOIN s ON true WHERE s.hour = q.hour - lag GROUP BY lag")
def lag_correlation(spark, sf_dir):
    """Correlation of hourly activity with a signal at lags of up to a day."""
    s = hourly(spark, sf_dir).where("metric = 'view'").select("hour", "v")
    q = hour_counts(spark, sf_dir).withColumn("lag", F.explode(F.sequence(F.lit(-24), F.lit(24)))).withColumn("hour", F.col("hour") - F.col("lag"))
    return q.join(s, "hour").groupBy(F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("n"), F.round(F.corr("v", F.col("n").cast("double")), 5).alias("r"))


@query(f"WITH {HOURS}, {QUAKES}, e AS (SELECT CAST(floor(ep / 3600) AS BIGINT) AS hour FROM quakes WHERE magnitude >= 5), l AS (SELECT range - 72 AS lag FROM range(145)) SELECT lag, count(*) AS n, round(avg(v), 8) AS mean FROM e, l, s WHERE s.hour = e.hour + lag GROUP BY lag")
def superposed_epoch(spark, sf_dir):
    """The signal's mean at each lag from strong events."""
    s = hourly(spark, sf_dir).where("metric = 'view'").select("hour", "v")
    e = zoned(spark, sf_dir).where("magnitude >= 5").select(F.floor(F.col("ep") / 3600).alias("at"), F.explode(F.sequence(F.lit(-72), F.lit(72))).alias("lag"))
    return e.withColumn("hour", F.col("at") + F.col("lag")).join(s, "hour").groupBy(F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 8).alias("mean"))


@query(f"""WITH {HOURS}, c AS (SELECT quantile_cont(v, 0.9) AS cut FROM s), j AS (SELECT v > cut AS storm, coalesce(q.n, 0) AS n FROM s LEFT JOIN q USING (hour), c)
SELECT round(avg(n) FILTER (storm) / avg(n) FILTER (NOT storm), 5) AS ratio, count(*) FILTER (storm) AS n_storm FROM j""")
def storm_rate_ratio(spark, sf_dir):
    s = hourly(spark, sf_dir).where("metric = 'view'").select("hour", "v")
    cut = F.broadcast(s.agg(F.percentile("v", 0.9).alias("cut")))
    j = s.join(hour_counts(spark, sf_dir), "hour", "left").join(cut).withColumns({"storm": F.col("v") > F.col("cut"), "n": F.coalesce("n", F.lit(0))})
    return j.agg(F.round(F.avg(F.when(F.col("storm"), F.col("n"))) / F.avg(F.when(~F.col("storm"), F.col("n"))), 5).alias("ratio"), F.count_if(F.expr("storm")).alias("n_storm"))


@query(f"""WITH {SAMPLES}, r AS (SELECT metric, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS mid FROM samples WHERE metric IN ('view', 'click')),
u AS (SELECT sum(CASE WHEN metric = 'view' THEN mid END) AS s, count(*) FILTER (metric = 'view') AS n1, count(*) FILTER (metric = 'click') AS n2 FROM r)
SELECT n1, n2, round(s - n1 * (n1 + 1) / 2, 1) AS u, round((s - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1.0) / 12), 5) AS z FROM u""")
def mann_whitney(spark, sf_dir):
    """Mid-ranks from counts by value; the values are ranked in ranges so that no task has all of them."""
    by = samples(spark, sf_dir).where("metric in ('view', 'click')").groupBy("value").agg(F.count_if(F.expr("metric = 'view'")).alias("a"), F.count_if(F.expr("metric = 'click'")).alias("b")).withColumn("part", F.floor("value"))
    whole = by.groupBy("part").agg(F.sum(F.col("a") + F.col("b")).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    w = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    inner = by.withColumn("within", F.coalesce(F.sum(F.col("a") + F.col("b")).over(w), F.lit(0))).join(whole, "part")
    mid = F.col("before") + F.col("within") + (F.col("a") + F.col("b") + 1) / 2
    u = inner.agg(F.sum(F.col("a") * mid).alias("s"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    return u.select("n1", "n2", F.round(F.expr("s - n1 * (n1 + 1) / 2"), 1).alias("u"), F.round(F.expr("(s - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1.0D) / 12)"), 5).alias("z"))


#: Weights of rate, b-value, acceleration and strength, and the least scores of the levels.
WEIGHTS = (0.35, 0.25, 0.15, 0.25)
LEVEL = "CASE WHEN score >= 0.75 THEN 'ALERT' WHEN score >= 0.5 THEN 'ELEVATED' WHEN score >= 0.25 THEN 'WATCH' ELSE 'NORMAL' END"


@query(f"""WITH {ZONED}, m AS (SELECT max(t) AS now FROM z), r AS (SELECT zone, now - t AS age, magnitude FROM z, m WHERE now - t <= {30 * DAY}), zs AS (SELECT DISTINCT zone FROM r),
g6 AS (SELECT zs.zone, g.range AS bin, count(r.age) AS n FROM zs CROSS JOIN range(120) g LEFT JOIN r ON r.zone = zs.zone AND floor(r.age / 21600) = g.range GROUP BY 1, 2),
g1 AS (SELECT zs.zone, g.range AS bin, count(r.age) AS n FROM zs CROSS JOIN range(168) g LEFT JOIN r ON r.zone = zs.zone AND floor(r.age / 3600) = g.range GROUP BY 1, 2),
s6 AS (SELECT zone, max(n) FILTER (bin = 0) AS now6, avg(n) FILTER (bin > 0) AS mean6, var_pop(n) FILTER (bin > 0) AS var6, avg(n) FILTER (bin < 4) AS recent, avg(n) FILTER (bin BETWEEN 4 AND 7) AS older FROM g6 GROUP BY 1),
s1 AS (SELECT zone, max(n) FILTER (bin = 0) AS now1, avg(n) FILTER (bin > 0) AS mean1, var_pop(n) FILTER (bin > 0) AS var1 FROM g1 GROUP BY 1),
a AS (SELECT zone, count(*) AS n30, avg(magnitude) AS m30, count(*) FILTER (age <= {7 * DAY}) AS n7, avg(magnitude) FILTER (age <= {7 * DAY}) AS m7, max(magnitude) FILTER (age <= {DAY}) AS top1, max(magnitude) FILTER (age <= {3 * DAY}) AS top3 FROM r GROUP BY 1),
c AS (SELECT zone, least(1, greatest(0, greatest((now6 - mean6) / CASE WHEN var6 > 1e-12 THEN sqrt(var6) ELSE greatest(1, mean6 * 0.5) END, 0.8 * (now1 - mean1) / CASE WHEN var1 > 1e-12 THEN sqrt(var1) ELSE greatest(1, mean1 * 0.5) END) / 4.5)) AS rate,
  coalesce(least(1, greatest(0, (CASE WHEN n30 >= 15 AND m30 - 2.45 > 0.01 THEN 0.4342944819032518 / (m30 - 2.45) END - CASE WHEN n7 >= 15 AND m7 - 2.45 > 0.01 THEN 0.4342944819032518 / (m7 - 2.45) END) / 0.35)) , 0) AS b0, (n30 >= 15 AND m30 - 2.45 > 0.01 AND n7 >= 15 AND m7 - 2.45 > 0.01) AS known,
  CASE WHEN older > 0 THEN least(1, greatest(0, (recent - older) / older / 2)) ELSE 0 END AS accel, greatest(least(1, greatest(0, (coalesce(top1, 0) - 4) / 3.5)), 0.7 * least(1, greatest(0, (coalesce(top3, 0) - 4) / 3.5))) AS strength FROM s6 JOIN s1 USING (zone) JOIN a USING (zone)),
s AS (SELECT zone, {WEIGHTS[0]} * rate + {WEIGHTS[1]} * CASE WHEN known THEN b0 ELSE 0 END + {WEIGHTS[2]} * accel + {WEIGHTS[3]} * strength AS score FROM c)
SELECT zone, round(score, 5) AS score, {LEVEL} AS level FROM s""")
def threat_scan(spark, sf_dir):
    """All zones of the last 30 days: rates in bins of six hours and of one against the bins before, the fall of the b-value, acceleration and strength, weighed into a level.

    Events are counted by hour of age first; bins without events come in by arithmetic.  Variances come from sums of whole numbers, so 0 is exact."""
    z = zoned(spark, sf_dir)
    z = z.join(F.broadcast(z.agg(F.max("t").alias("now")))).select("zone", (F.col("now") - F.col("t")).alias("age"), F.col("magnitude").alias("m")).where(F.col("age") <= 30 * DAY)
    c, m, n = F.col, F.col("m"), F.col("n")
    within = lambda days: F.when(c("age") <= days * DAY, m)
    hours = z.groupBy("zone", F.floor(c("age") / 3600).alias("hour")).agg(F.count("*").alias("n"), F.sum(m).alias("s30"), F.count(within(7)).alias("n7"), F.sum(within(7)).alias("s7"), F.max(within(1)).alias("top1"), F.max(within(3)).alias("top3"))
    old1 = F.when((c("hour") > 0) & (c("hour") < 168), n).otherwise(0)
    bins = hours.groupBy("zone", F.floor(c("hour") / 6).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum(F.when(c("hour") == 0, n).otherwise(0)).alias("now1"), F.sum(old1).alias("c1"), F.sum(old1 * old1).alias("q1"),
        *(F.sum(k).alias(k) for k in ("s30", "n7", "s7")), F.max("top1").alias("top1"), F.max("top3").alias("top3"),
    )
    old6 = F.when((c("bin") > 0) & (c("bin") < 120), n).otherwise(0)
    part = lambda on: F.sum(F.when(on, n).otherwise(0))
    a = bins.groupBy("zone").agg(
        part(c("bin") == 0).alias("now6"), F.sum(old6).alias("c6"), F.sum(old6 * old6).alias("q6"), part(c("bin") < 4).alias("recent"), part(c("bin").between(4, 7)).alias("older"), F.sum("n").alias("n30"),
        *(F.sum(k).alias(k) for k in ("now1", "c1", "q1", "s30", "n7", "s7")), F.max("top1").alias("top1"), F.max("top3").alias("top3"),
    )
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    def against(now, count, squares, k):
        mean, var = count / k, (k * squares - count * count) / (k * k)
        return (now - mean) / F.when(var > 0, F.sqrt(var)).otherwise(F.greatest(F.lit(1.0), 0.5 * mean))

    def b(total, count):
        over = total / count - 2.45
        return F.when((count >= 15) & (over > 0.01), 0.4342944819032518 / over)

    rate = clip(F.greatest(against(c("now6"), c("c6"), c("q6"), 119), 0.8 * against(c("now1"), c("c1"), c("q1"), 167)) / 4.5)
    fall = clip(F.coalesce(b(c("s30"), c("n30")) - b(c("s7"), c("n7")), F.lit(0.0)) / 0.35)
    accel = clip(F.when(c("older") > 0, (c("recent") - c("older")) / c("older") / 2).otherwise(0.0))
    top = lambda k: clip((F.coalesce(k, F.lit(0.0)) - 4) / 3.5)
    strength = F.greatest(top("top1"), 0.7 * top("top3"))
    score = sum(w * x for w, x in zip(WEIGHTS, (rate, fall, accel, strength), strict=True))
    return a.select("zone", score.alias("score")).select("zone", F.round("score", 5).alias("score"), F.expr(LEVEL).alias("level"))


def ranked(z):
    """Events with their rank k by time and their number n.  Ranks come from counts by hour and ranks within the hour, so that no task sorts all events."""
    z = z.withColumn("hour", F.floor(F.col("ep") / 3600))
    by = z.groupBy("hour").agg(F.count("*").alias("c"))
    by = by.select("hour", F.coalesce(F.sum("c").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    return z.join(by, "hour").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("hour").orderBy("ep", "event_id")))


@query(f"""WITH {ZONED}, r AS (SELECT *, row_number() OVER (ORDER BY ep, event_id) AS k, count(*) OVER () AS n FROM z)
SELECT CASE WHEN k <= 0.7 * n THEN 'train' WHEN k <= 0.85 * n THEN 'valid' ELSE 'test' END AS part, count(*) AS n, min(event_id) AS low, round(avg(magnitude), 6) AS mean FROM r GROUP BY 1""")
def temporal_split(spark, sf_dir):
    """70, 15 and 15 percent by time."""
    k, n = F.col("k"), F.col("n")
    part = F.when(k <= 0.7 * n, "train").when(k <= 0.85 * n, "valid").otherwise("test")
    return ranked(zoned(spark, sf_dir)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.round(F.avg("magnitude"), 6).alias("mean"))
