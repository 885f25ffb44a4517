"""Buoys, triggers and spectra of stations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import signals
from ..operators.ordered import numbered
from ..operators.signals import READINGS, TIDES
from ..sources.projection import SAMPLES, samples, table
from .registry import query

#: Readings of three buoys: a height in metres, some in event mode (2) or tsunami mode (3).
BUOYS = "buoys AS (SELECT user_id % 3 AS station, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS t, event_id, CASE WHEN event_id % 13 = 0 THEN 2 WHEN event_id % 29 = 0 THEN 3 ELSE 1 END AS mode, 4000 + value / 100 AS height FROM events)"


def buoys(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 3).alias("station"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), k, F.when(k % 13 == 0, 2).when(k % 29 == 0, 3).otherwise(1).alias("mode"), (4000 + F.col("value") / 100).alias("height"))


N = 2 + 2 * len(TIDES)
WAVES = ", ".join(f"{f}(2 * pi() * hours / {p})" for p in TIDES for f in ("sin", "cos"))
#: Normal equations, solved by elimination: a list of rows a station, one more column for the right side.
DETREND = f"""{BUOYS}, a AS (SELECT station, max(t) AS now FROM buoys GROUP BY 1), b AS (SELECT buoys.*, now FROM buoys JOIN a USING (station) WHERE t >= now - 604800),
k AS (SELECT station, min(t) FILTER (mode = 1) AS t0, min(height) FILTER (mode = 1) AS h0 FROM b GROUP BY 1 HAVING count(*) >= {READINGS} AND count(*) FILTER (mode = 1) >= {READINGS}),
x AS (SELECT *, list_append(v, h) AS w FROM (SELECT station, now, t, event_id, mode, height - h0 AS h, [1.0, hours / 168, {WAVES}] AS v FROM (SELECT b.*, h0, (t - t0) / 3600.0::DOUBLE AS hours FROM b JOIN k USING (station)))),
g AS (SELECT station, list(line ORDER BY i) AS m FROM (SELECT station, i, list(s ORDER BY j) AS line FROM (SELECT station, i, j, sum(v[i] * w[j]) AS s FROM x, (SELECT unnest(range(1, {N + 1})) AS i), (SELECT unnest(range(1, {N + 2})) AS j) WHERE mode = 1 GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT station, 0 AS p, m FROM g UNION ALL SELECT station, p + 1, list_transform(range(1, {N + 1}), lambda i: CASE WHEN i = p + 1 THEN list_transform(m[p + 1], lambda y: y / m[p + 1][p + 1]) ELSE list_transform(range(1, {N + 2}), lambda j: m[i][j] - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1]) END) FROM e WHERE p < {N}),
d AS (SELECT x.station, now, t, event_id, mode, CASE WHEN mode = 1 THEN (h - list_sum(list_transform(range(1, {N + 1}), lambda i: v[i] * m[i][{N + 1}]))) * 1000 END AS mm FROM x JOIN e ON e.station = x.station AND p = {N}),
q AS (SELECT *, (now - t) / 3600 AS age, CASE WHEN mode = 1 THEN row_number() OVER (PARTITION BY station, mode ORDER BY t, event_id) END AS k FROM d)"""


def slope(old: int, young: int | None = None) -> tuple[str, str]:
    """(slope over places, number) of the residuals of a span of ages."""
    on = f"mm IS NOT NULL AND age <= {old}" + (f" AND age > {young}" if young is not None else "")
    return f"regr_slope(mm, k) FILTER ({on})", f"count(*) FILTER ({on})"


def std(old: int, young: int | None = None) -> str:
    return f"stddev_pop(mm) FILTER (age <= {old}" + (f" AND age > {young})" if young is not None else ")")


(S6, N6), (S12, N12), (S48, N48), (SW, NW), (SE, NE) = (slope(*x) for x in ((6,), (12,), (48,), (36, 12), (72, 48)))


@query(f"""WITH RECURSIVE {DETREND} SELECT station, round(coalesce(avg(mm) FILTER (age <= 24), 0), 4) AS residual_mean_24h, round(coalesce({std(24)}, 0), 4) AS residual_std_24h, round(CASE WHEN {N48} > 4 THEN {S48} * {N48} / 2 ELSE 0 END, 4) AS residual_trend_48h,
round(CASE WHEN {N6} > 1 THEN (arg_max(mm, k) FILTER (age <= 6 AND mode = 1) - arg_min(mm, k) FILTER (age <= 6 AND mode = 1)) / 6 ELSE 0 END, 4) AS rate_of_change_6h, round(coalesce(avg(mm) FILTER (age <= 96) - avg(mm) FILTER (age > 96), 0), 4) AS loading_index,
round(CASE WHEN {NE} > 4 AND {N48} > 4 THEN ({S48} - {SE}) * {NE} ELSE 0 END, 4) AS trend_reversal, round(CASE WHEN {N6} > 2 AND count(mm) FILTER (age <= 24 AND age > 6) > 2 THEN {std(6)} / greatest(0.01, {std(24, 6)}) END, 4) AS vol_ramp_6v18,
round(CASE WHEN {N12} > 2 AND {NW} > 2 THEN {std(12)} / greatest(0.01, {std(36, 12)}) END, 4) AS vol_ramp_12v36, round(CASE WHEN {N6} > 2 THEN {std(6)} END, 4) AS std_6h, round(CASE WHEN {N12} > 2 THEN {std(12)} END, 4) AS std_12h,
round(CASE WHEN {N12} > 4 THEN {S12} * {N12} / 0.5 END, 4) AS trend_12h, round(CASE WHEN {N6} > 3 THEN {S6} * {N6} / 0.25 END, 4) AS trend_6h, round(CASE WHEN {N12} > 4 AND {NW} > 4 THEN {S12} * {N12} / 0.5 - {SW} * {NW} END, 4) AS trend_accel,
count(*) FILTER (mode > 1) AS event_mode_7d, count(*) FILTER (mode > 1 AND age <= 24) AS event_mode_24h, count(*) FILTER (mode > 1 AND age <= 12) AS event_mode_12h, count(*) FILTER (mode > 1 AND age <= 6) AS event_mode_6h,
round(count(*) FILTER (mode > 1 AND age <= 12) / greatest(1, count(*) FILTER (mode > 1 AND age > 24)), 4) AS event_mode_accel FROM q GROUP BY station""")
def buoy_features(spark, sf_dir):
    """What a buoy's last week shows once the tides are taken out."""
    d = signals.detrended(buoys(spark, sf_dir))
    normal = numbered(d.where("mode = 1"), ["station"], ["t", "event_id"], F.floor(F.col("t") / 3600))
    return signals.residual_features(normal.unionByName(d.where("mode <> 1"), allowMissingColumns=True))


#: Samples of the short and the long mean, ratio of a trigger, seconds of pause; the estimate's factor, base and limits.
SHORT, LONG, RATIO, PAUSE = 2, 50, 3.5, 43200
PER_DECADE, OFFSET, SMALLEST, LARGEST = 1.1, -1.5, 0.5, 8.5


@query(f"""WITH RECURSIVE s AS (SELECT user_id % 4 AS station, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS t, event_id, CAST(floor(value * 100) AS BIGINT) AS a, row_number() OVER (PARTITION BY user_id % 4 ORDER BY floor(epoch_us(ts) / 1e6), event_id) - 1 AS k FROM events),
r AS (SELECT *, sum(a) OVER (PARTITION BY station ORDER BY k ROWS BETWEEN {SHORT - 1} PRECEDING AND CURRENT ROW) / {SHORT} AS sta, sum(a) OVER (PARTITION BY station ORDER BY k ROWS BETWEEN {LONG - 1} PRECEDING AND CURRENT ROW) / {LONG} AS lta FROM s),
c AS (SELECT *, sta / lta AS ratio FROM r WHERE k >= {LONG - 1} AND lta > 0 AND sta / lta > {RATIO}),
n AS (SELECT a.station, a.k, min(b.k) AS nk FROM c a JOIN c b ON b.station = a.station AND b.t > a.t + {PAUSE} GROUP BY 1, 2),
taken AS (SELECT station, min(k) AS k FROM c GROUP BY 1 UNION ALL SELECT n.station, nk FROM taken JOIN n USING (station, k))
SELECT station, event_id, t, round(ratio, 6) AS ratio, a AS peak, round(least(greatest({PER_DECADE} * log10(greatest(a, 1)) + {OFFSET}, {SMALLEST}), {LARGEST}), 1) AS magnitude FROM taken JOIN c USING (station, k)""")
def trigger_detections(spark, sf_dir):
    """Short over long means of stations' samples; each trigger taken silences its station for a while, and has a magnitude from its amplitude."""
    e = samples(spark, sf_dir).select("event_id", F.floor("ep").alias("t"), F.floor(F.col("value") * 100).alias("amplitude")).join(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("station")), "event_id")
    s = numbered(e, ["station"], ["t", "event_id"], F.floor(F.col("t") / 86400))
    found = signals.short_over_long(s, SHORT, LONG).where(F.col("ratio") > RATIO)
    taken = signals.with_pause(found, PAUSE)
    size = PER_DECADE * F.log10(F.greatest("amplitude", F.lit(1))) + OFFSET
    return taken.select("station", "event_id", "t", F.round("ratio", 6).alias("ratio"), F.col("amplitude").alias("peak"), F.round(F.least(F.greatest(size, F.lit(SMALLEST)), F.lit(LARGEST)), 1).alias("magnitude"))


#: A sample a second of four stations.
SERIES = "series AS (SELECT l_suppkey % 4 AS station, row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS k, l_quantity AS x FROM lineitem)"


def series(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("station"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"))
    return numbered(s, ["station"], ["l_orderkey", "l_linenumber", "x"], F.floor(F.col("l_orderkey") / 10_000)).select("station", "k", "x")


@query(f"""WITH {SERIES}, w AS (SELECT station, unnest(range(0, max(k) - 598, 300)) AS a FROM series GROUP BY 1), x AS (SELECT w.station, a // 300 AS w, k - a AS i, x - avg(x) OVER (PARTITION BY w.station, a) AS x FROM w JOIN series s ON s.station = w.station AND k BETWEEN a AND a + 599),
h AS (SELECT station, w, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 599)) AS x FROM x), p AS (SELECT station, w, b, (pow(sum(x * cos(2 * pi() * b * i / 600)), 2) + pow(sum(x * sin(2 * pi() * b * i / 600)), 2)) / 600 AS power FROM h, (SELECT unnest(range(2, 13)) AS b) GROUP BY 1, 2, 3),
s AS (SELECT w, b, avg(power) AS p, count(*) AS stations FROM p GROUP BY 1, 2)
SELECT w, max(stations) AS stations, round(arg_max(b, struct_pack(p := p, b := -b)) / 600 * 1000, 3) AS peak_mhz, round(log10(sum(p) + 1e-30), 4) AS log_power, round(sum(b * p) / sum(p) / 600 * 1000, 3) AS centroid_mhz FROM s GROUP BY 1 HAVING max(stations) >= 3""")
def spectral_stack(spark, sf_dir):
    """Spectra of ten minutes every five, stacked over the stations, between 2 and 20 millihertz."""
    return signals.resonance(signals.spectra(series(spark, sf_dir), rate=1.0, butterworth=False))


@query()
def resonance(spark, sf_dir):
    """The same after a Butterworth band pass, whose recursion is beyond SQL."""
    return signals.resonance(signals.spectra(series(spark, sf_dir), rate=1.0))


@query(f"""WITH {SAMPLES}, b AS (SELECT metric, CAST(floor(ep / 300) AS BIGINT) AS bin, min(value) AS low, max(value) AS top, avg(value) AS mean, count(*) FILTER (value > 150) AS triggered FROM samples GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY bin) AS k FROM b)
SELECT metric, bin, round(top - low, 6) AS amp_range, round(sqrt(avg(mean * mean) OVER h), 6) AS rms_1h, max(top) OVER h AS top_1h, CAST(sum(triggered) OVER h AS BIGINT) AS triggers_1h, round(CASE WHEN k > 1 THEN regr_slope(mean, k) OVER h ELSE 0 END, 6) AS trend_1h,
round(CASE WHEN k >= 12 THEN mean - avg(mean) OVER (PARTITION BY metric ORDER BY bin ROWS BETWEEN 71 PRECEDING AND CURRENT ROW) ELSE 0 END, 10) AS noise_floor_delta FROM n WINDOW h AS (PARTITION BY metric ORDER BY bin ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def station_rolling(spark, sf_dir):
    """Five-minute bins of a station: range, root mean square, strongest, triggers and slope of the last hour (12 bins), and the mean against the floor of six hours.

    Frames run over bins, of which a station has 288 a day whatever its rate."""
    v = F.col("value")
    b = samples(spark, sf_dir).groupBy("metric", F.floor(F.col("ep") / 300).alias("bin")).agg(F.min(v).alias("low"), F.max(v).alias("top"), F.avg(v).alias("mean"), F.count_if(v > 150).alias("triggered"))
    by = Window.partitionBy("metric").orderBy("bin")
    hour, floor = by.rowsBetween(-11, 0), by.rowsBetween(-71, 0)
    n = b.withColumn("k", F.row_number().over(by))
    delta = F.when(F.col("k") >= 12, F.col("mean") - F.avg("mean").over(floor)).otherwise(0.0)
    return n.select("metric", "bin", F.round(F.col("top") - F.col("low"), 6).alias("amp_range"), F.round(F.sqrt(F.avg(F.col("mean") * F.col("mean")).over(hour)), 6).alias("rms_1h"), F.max("top").over(hour).alias("top_1h"), F.sum("triggered").over(hour).alias("triggers_1h"), F.round(F.coalesce(F.regr_slope("mean", "k").over(hour), F.lit(0.0)), 6).alias("trend_1h"), F.round(delta, 10).alias("noise_floor_delta"))
