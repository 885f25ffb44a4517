"""Threat of zones with its boosts by tides, storms, buoys, volcanoes and forecasts; risk of fault segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sky import LOCAL, STEPS, steps_sql, with_steps
from ..operators.ordered import carried, numbered
from ..sources.projection import DAY, QUAKES, SAMPLES, STATIONS, ZONES, quakes, samples, stations, table, zones
from .analytics import FORECASTS, LEVEL, forecasts, threat_scan
from .hazards import FAULTS
from .profiles import BUOY_LAT, BUOY_LON
from .registry import ORACLES, query
from .waves import BUOYS, buoys

C = F.col
#: More segments than this are no dimension to be broadcast.
MOST_SEGMENTS = 100_000

#: Seconds that each sensor is looked back, and degrees round a zone in which buoys and volcanoes count.
LOOKBACK, BUOY_PAD, VOLCANO_PAD = {"dst": 6 * 3600, "orbit": 6 * 3600, "ground": 3 * 3600}, 15, 5
#: Days of thermal anomalies, and the least peak that counts.
HOT_DAYS, HOT = 3, 15
SENSOR = "CASE metric WHEN 'click' THEN 'dst' WHEN 'purchase' THEN 'orbit' ELSE 'ground' END"
READING = "CASE metric WHEN 'click' THEN -value / 5 ELSE value END"
SPAN = f"CASE WHEN metric IN ('click', 'purchase') THEN {LOOKBACK['dst']} ELSE {LOOKBACK['ground']} END"
#: Shares of a sensor's readings (place k of n): a quarter, a third, a third of the changes.
SHARES = (("quarter", "greatest(1, floor(n / 4))"), ("third", "greatest(2, floor(n / 3))"), ("steps", "greatest(2, floor((n - 1) / 3))"))
MEANS = {
    "n": "max(n)", "young4": "avg(CASE WHEN k >= n - quarter THEN v END)", "old4": "avg(CASE WHEN k < quarter THEN v END)", "t1": "min(CASE WHEN k >= n - quarter THEN ep END)", "t0": "max(CASE WHEN k < quarter THEN ep END)",
    "jump": "avg(CASE WHEN k >= n - third THEN v END) - avg(CASE WHEN k < n - third THEN v END)", "young_d": "avg(CASE WHEN k >= n - steps THEN abs(v - prev) END)", "old_d": "avg(CASE WHEN k >= 1 AND k < n - steps THEN abs(v - prev) END)",
}
#: Severity of each sensor's onset: a fall of the storm index an hour, a jump of the field in orbit, changes on the ground against those before.
SEVERITY = (
    ("rate", "(young4 - old4) / greatest(0.5e0, (t1 - t0) / 3600e0)"),
    ("ratio", "CASE WHEN old_d > 0.01e0 THEN young_d / old_d END"),
    ("severity", """CASE WHEN sensor = 'dst' AND n >= 4 AND rate < -8 THEN round(least(1e0, -rate / 25), 3) WHEN sensor = 'orbit' AND n >= 6 AND jump > 10 THEN round(least(1e0, jump / 40), 3)
  WHEN sensor = 'orbit' AND n >= 6 AND jump < -15 THEN round(least(1e0, -jump / 50), 3) WHEN sensor = 'ground' AND n >= 12 AND ratio > 2 THEN round(least(1e0, (ratio - 1) / 4), 3) ELSE 0e0 END"""),
)
BUOY_BOOST = "CASE WHEN max(mode) >= 3 THEN 0.15e0 WHEN max(mode) >= 2 THEN 0.1e0 WHEN sum(CASE WHEN mode >= 2 OR deviation >= 1.5e0 THEN 1 ELSE 0 END) >= 2 THEN 0.06e0 ELSE 0e0 END"
DEVIATION = "CASE WHEN n < 4 THEN 0e0 WHEN var <= 0 THEN abs(last - mean) WHEN sqrt(var) > 0.001e0 THEN abs(last - mean) / sqrt(var) ELSE 0e0 END"
VOLCANO_BOOST = "CASE WHEN max(frp) >= 100 THEN 0.1e0 WHEN max(frp) >= 50 THEN 0.06e0 ELSE 0.03e0 END + CASE WHEN count(*) >= 3 THEN 0.03e0 ELSE 0e0 END"


def _step(name: str, before: str, after: str) -> tuple[tuple[str, str], tuple[str, str]]:
    return (name, f"round(least(1e0, {after}) + 1e-9, 4)"), (f"{name}_boost", f"round({name} - {before}, 4)")


#: The boosts in their order; each works on what the one before it leaves.
BOOSTS = (
    ("base", "round(score + 1e-9, 4)"),
    *_step("tidal", "base", "CASE WHEN stress > 0.4e0 AND base > 0.05e0 THEN base * (1 + 0.25e0 * stress) ELSE base END"),
    *_step("geomag", "tidal", "CASE WHEN onset > 0.1e0 AND tidal > 0.05e0 THEN tidal * (1 + 0.35e0 * onset) ELSE tidal END"),
    *_step("dart", "geomag", "geomag + coalesce(buoy, 0e0)"),
    *_step("volcanic", "dart", "dart + coalesce(volcano, 0e0)"),
    *_step("ml", "volcanic", "CASE WHEN p > 0.5e0 AND volcanic > 0.05e0 THEN volcanic * (1 + 1.2e0 * (p - 0.5e0)) ELSE volcanic END"),
)
OUT = ["zone", "base", "tidal_boost", "geomag_boost", "dart_boost", "volcanic_boost", "ml_boost"]


def onset(readings: DataFrame) -> DataFrame:
    """One row: ``onset``, the greatest severity of the sensors (sensor, ep, event_id, v); 0 without readings.

    Places and earlier values come by blocks of ten minutes, so that a sensor with many readings is not one task."""
    block = F.floor(C("ep") / 600)
    r = carried(readings, ["sensor"], ["ep", "event_id"], "v", block, "prev", own=False)
    r = numbered(r, ["sensor"], ["ep", "event_id"], block)
    r = with_steps(r.join(F.broadcast(readings.groupBy("sensor").agg(F.count("*").alias("n"))), "sensor"), SHARES)
    return with_steps(r.groupBy("sensor").agg(*(F.expr(x).alias(name) for name, x in MEANS.items())), SEVERITY).agg(F.coalesce(F.max("severity"), F.lit(0.0)).alias("onset"))


@query(f"""WITH {QUAKES}, {SAMPLES}, {STATIONS}, {ZONES}, {BUOYS}, {FORECASTS}, w AS (SELECT max(ep) AS now FROM quakes), scan AS ({ORACLES["threat_scan"]}),
r AS (SELECT {SENSOR} AS sensor, ep, event_id, {READING} AS v FROM samples, w WHERE metric <> 'view' AND ep >= now - {SPAN}), k AS (SELECT *, row_number() OVER o - 1 AS k, lag(v) OVER o AS prev, count(*) OVER (PARTITION BY sensor) AS n FROM r WINDOW o AS (PARTITION BY sensor ORDER BY ep, event_id)),
h AS ({steps_sql("k", SHARES)}), m AS (SELECT sensor, {", ".join(f"{x} AS {name}" for name, x in MEANS.items())} FROM h GROUP BY sensor), s AS ({steps_sql("m", SEVERITY)}), o AS (SELECT coalesce(max(severity), 0) AS onset FROM s),
c AS (SELECT zone, now AS ep, 0e0 AS lat, lon_lo + 17.5e0 AS lon FROM zones, w), t AS ({steps_sql("c", STEPS + LOCAL)}),
b AS (SELECT station, {BUOY_LON} AS lon, arg_max(mode, struct_pack(a := t, b := event_id)) AS mode, arg_max(height, struct_pack(a := t, b := event_id)) AS last, count(*) AS n, avg(height) AS mean, var_pop(height) AS var FROM buoys, w WHERE t >= now - 21600 GROUP BY station),
d AS (SELECT zone, {BUOY_BOOST} AS buoy FROM zones JOIN (SELECT *, {DEVIATION} AS deviation FROM b) ON lon BETWEEN lon_lo - {BUOY_PAD} AND lon_hi + {BUOY_PAD} GROUP BY zone),
v AS (SELECT station, any_value(s.lon) AS lon, max(depth_km) / 2.5e0 AS frp FROM quakes q JOIN stations s ON station = 1 + event_id % 100, w WHERE event_id % 9 = 0 AND ep >= now - {HOT_DAYS * DAY} GROUP BY station HAVING max(depth_km) / 2.5e0 >= {HOT}),
a AS (SELECT zone, {VOLCANO_BOOST} AS volcano FROM zones JOIN v ON lon BETWEEN lon_lo - {VOLCANO_PAD} AND lon_hi + {VOLCANO_PAD} GROUP BY zone),
f AS (SELECT zone, arg_max(p, struct_pack(a := issued, b := fid)) AS p FROM forecasts GROUP BY zone),
j AS (SELECT scan.zone, score, stress, onset, buoy, volcano, p FROM scan JOIN t USING (zone) LEFT JOIN d USING (zone) LEFT JOIN a USING (zone) LEFT JOIN f USING (zone), o), x AS ({steps_sql("j", BOOSTS)}), y AS (SELECT {", ".join(OUT)}, round(stress, 4) AS tidal_stress, onset, ml AS score FROM x)
SELECT *, {LEVEL} AS level, row_number() OVER (ORDER BY score DESC, zone) AS place FROM y""")
def threat_boosted(spark, sf_dir):
    """The scan's zones with their scores raised in turn by tides, a geomagnetic onset, buoys, volcanoes and the last forecast, levelled again and ranked.

    Zones are twelve; buoys and volcanoes are aggregated by station before they meet them."""
    q = quakes(spark, sf_dir)
    now = F.broadcast(q.agg(F.max("ep").alias("now")))
    z = F.broadcast(zones(spark))
    r = samples(spark, sf_dir).join(now).where((C("metric") != "view") & (C("ep") >= C("now") - F.expr(SPAN)))
    o = onset(r.select(F.expr(SENSOR).alias("sensor"), "ep", "event_id", F.expr(READING).alias("v")))
    t = with_steps(zones(spark).join(now).select("zone", C("now").alias("ep"), F.lit(0.0).alias("lat"), (C("lon_lo") + 17.5).alias("lon")), STEPS + LOCAL).select("zone", "stress")
    by = F.struct("t", "event_id")
    b = buoys(spark, sf_dir).join(now).where(C("t") >= C("now") - 21600).groupBy("station").agg(F.max_by("mode", by).alias("mode"), F.max_by("height", by).alias("last"), F.count("*").alias("n"), F.avg("height").alias("mean"), F.var_pop("height").alias("var"))
    b = b.withColumns({"lon": F.expr(BUOY_LON), "deviation": F.expr(DEVIATION)})
    near = lambda pad: (C("lon") >= C("lon_lo") - pad) & (C("lon") <= C("lon_hi") + pad)
    d = b.join(z, near(BUOY_PAD)).groupBy("zone").agg(F.expr(BUOY_BOOST).alias("buoy"))
    hot = q.join(now).where((C("event_id") % 9 == 0) & (C("ep") >= C("now") - HOT_DAYS * DAY)).groupBy((1 + C("event_id") % 100).alias("station")).agg((F.max("depth_km") / 2.5).alias("frp")).where(C("frp") >= HOT)
    a = hot.join(stations(spark, sf_dir), "station").join(z, near(VOLCANO_PAD)).groupBy("zone").agg(F.expr(VOLCANO_BOOST).alias("volcano"))
    f = forecasts(spark, sf_dir).groupBy("zone").agg(F.max_by("p", F.struct("issued", "fid")).alias("p"))
    j = threat_scan(spark, sf_dir).drop("level").join(t, "zone").join(d, "zone", "left").join(a, "zone", "left").join(f, "zone", "left").join(F.broadcast(o))
    y = with_steps(j, BOOSTS).select(*OUT, F.round("stress", 4).alias("tidal_stress"), "onset", C("ml").alias("score"))
    return y.withColumns({"level": F.expr(LEVEL), "place": F.expr("row_number() OVER (ORDER BY score DESC, zone)")})


#: Degrees round a segment's middle and kilometres of a buoy; the least risk that is reported.
DEGREES, BUOY_KM, LEAST_RISK = 8, 2000, 0.03
#: The parts of a segment's risk, and the risk.
PARTS = (
    ("coulomb", "least(1e0, log10(greatest(1e0, coalesce(stress, 0e0))) / 20)"), ("seismicity", "least(1e0, coalesce(energy, 0e0) / 40)"), ("often", "least(1e0, coalesce(events_30d, 0) / 60e0)"),
    ("geomag", "least(1e0, greatest(0e0, kp - 2) / 6) * 0.6e0 + least(1e0, greatest(0e0, -dst - 10) / 90) * 0.4e0"), ("buoy", "coalesce(raised, 0e0)"),
    ("whole", "0.3e0 * coulomb + 0.3e0 * seismicity + 0.15e0 * often + 0.1e0 * geomag + 0.15e0 * buoy"),
    ("risk", "round(least(1e0, CASE WHEN buoy > 0.3e0 THEN least(1e0, whole + 0.25e0 * buoy) ELSE whole END), 4)"),
)
RAISED = f"least(1e0, least(1e0, events / 60e0) + CASE WHEN tsunami THEN 0.5e0 ELSE 0e0 END) * (0.4e0 + 0.6e0 * (1 - km / {BUOY_KM}))"
FLAT = "sqrt(pow(({0} - mlat) * 111, 2) + pow(({1} - mlon) * 111 * cos(radians(mlat)), 2))"


def segments(spark, sf_dir) -> DataFrame:
    """fault and its middle.  A table that is broadcast, so its rows are counted first."""
    k = C("n_nationkey")
    s = table(spark, sf_dir, "nation").select(k.alias("fault"), (-50.0 + (k * 17 % 100 + k * 29 % 100) / 2).alias("mlat"), (-167.5 + k * 14).alias("mlon"))
    if (n := s.count()) > MOST_SEGMENTS:
        raise ValueError(f"{n} segments: at most {MOST_SEGMENTS} are held beside the events")
    return s


@query(f"""WITH {QUAKES}, {SAMPLES}, {BUOYS}, {FAULTS}, w AS (SELECT max(ep) AS now FROM quakes), g AS (SELECT fault, (ay + b_y) / 2 AS mlat, (ax + bx) / 2 AS mlon FROM faults),
n AS (SELECT *, sqrt(pow(lat - mlat, 2) + pow(lon - mlon, 2)) AS d, now - ep AS age FROM g JOIN quakes ON abs(lat - mlat) < {DEGREES} AND abs(lon - mlon) < {DEGREES}, w WHERE now - ep <= {30 * DAY}),
e AS (SELECT fault, count(*) FILTER (age <= {7 * DAY}) AS events_7d, count(*) AS events_30d, max(magnitude) FILTER (age <= {7 * DAY}) AS top, sum((1 - d / {DEGREES}) * pow(magnitude, 1.5e0)) FILTER (age <= {7 * DAY}) AS energy FROM n WHERE d < {DEGREES} GROUP BY fault),
c AS (SELECT fault, sum(pow(10e0, 1.5e0 * magnitude) / pow(greatest(1e0, {FLAT.format("lat", "lon")}), 2)) AS stress FROM g, quakes, w WHERE magnitude >= 5 AND now - ep <= {7 * DAY} GROUP BY fault),
b AS (SELECT station, {BUOY_LAT} AS blat, {BUOY_LON} AS blon, count(*) AS events, bool_or(mode = 3) AS tsunami FROM buoys, w WHERE mode > 1 AND t >= now - 43200 GROUP BY station),
r AS (SELECT fault, station, {RAISED} AS raised FROM (SELECT *, {FLAT.format("blat", "blon")} AS km FROM g, b) WHERE km < {BUOY_KM}), v AS (SELECT fault, max(raised) AS raised, arg_min(station, struct_pack(a := -raised, b := station)) AS dart_station FROM r GROUP BY fault),
m AS (SELECT CASE WHEN k >= 9.9 THEN 2.0 ELSE k END AS kp, d AS dst FROM (SELECT arg_max(value, struct_pack(a := ep, b := event_id)) FILTER (metric = 'view') / 55 AS k, -arg_max(value, struct_pack(a := ep, b := event_id)) FILTER (metric = 'click') / 5 AS d FROM samples)),
j AS (SELECT * FROM g LEFT JOIN e USING (fault) LEFT JOIN c USING (fault) LEFT JOIN v USING (fault), m), x AS ({steps_sql("j", PARTS)})
SELECT fault, risk, coalesce(events_7d, 0) AS events_7d, coalesce(events_30d, 0) AS events_30d, round(coalesce(top, 0), 1) AS max_mag_7d, round(kp, 1) AS kp, dart_station, round(raised, 3) AS dart_score, row_number() OVER (ORDER BY risk DESC, fault) AS place FROM x WHERE risk > {LEAST_RISK}""")
def fault_segments(spark, sf_dir):
    """Segments by risk: the stress of a week's strong events, near seismicity and its rate, geomagnetism, and buoys that report events.

    Near events meet segments by cells of eight degrees; strong events, which count everywhere, are added up for all segments before any shuffle."""
    q = quakes(spark, sf_dir)
    now = F.broadcast(q.agg(F.max("ep").alias("now")))
    recent = q.join(now).withColumn("age", C("now") - C("ep")).where(C("age") <= 30 * DAY).select("lat", "lon", "magnitude", "age")
    g = segments(spark, sf_dir)
    cell = lambda x: F.floor(x / DEGREES)
    round_it = lambda c: F.explode(F.sequence(cell(C(c) - DEGREES), cell(C(c) + DEGREES)))
    n = recent.withColumns({"y": cell(C("lat")), "x": cell(C("lon"))}).join(g.withColumn("y", round_it("mlat")).withColumn("x", round_it("mlon")), ["y", "x"])
    n = n.withColumns({"d": F.sqrt(F.pow(C("lat") - C("mlat"), 2) + F.pow(C("lon") - C("mlon"), 2)), "week": C("age") <= 7 * DAY}).where(C("d") < DEGREES)
    e = n.groupBy("fault").agg(F.count_if("week").alias("events_7d"), F.count("*").alias("events_30d"), F.max(F.when(C("week"), C("magnitude"))).alias("top"), F.sum(F.when(C("week"), (1 - C("d") / DEGREES) * F.pow("magnitude", F.lit(1.5)))).alias("energy"))
    apart = F.greatest(F.lit(1.0), F.expr(FLAT.format("lat", "lon")))
    c = recent.where((C("magnitude") >= 5) & (C("age") <= 7 * DAY)).join(F.broadcast(g)).groupBy("fault").agg(F.sum(F.pow(F.lit(10.0), 1.5 * C("magnitude")) / F.pow(apart, 2)).alias("stress"))
    b = buoys(spark, sf_dir).join(now).where((C("mode") > 1) & (C("t") >= C("now") - 43200)).groupBy("station").agg(F.count("*").alias("events"), F.bool_or(C("mode") == 3).alias("tsunami")).withColumns({"blat": F.expr(BUOY_LAT), "blon": F.expr(BUOY_LON)})
    v = b.join(F.broadcast(g)).withColumn("km", F.expr(FLAT.format("blat", "blon"))).where(C("km") < BUOY_KM).withColumn("raised", F.expr(RAISED))
    v = v.groupBy("fault").agg(F.max("raised").alias("raised"), F.min_by("station", F.struct(-C("raised"), "station")).alias("dart_station"))
    last = lambda metric, by: F.max_by(F.when(C("metric") == metric, C("value")), F.when(C("metric") == metric, F.struct("ep", "event_id"))) / by
    m = samples(spark, sf_dir).agg(last("view", 55).alias("kp"), (-last("click", 5)).alias("dst")).withColumn("kp", F.when(C("kp") >= 9.9, 2.0).otherwise(C("kp")))
    x = with_steps(g.join(e, "fault", "left").join(c, "fault", "left").join(v, "fault", "left").join(F.broadcast(m)), PARTS).where(C("risk") > LEAST_RISK)
    zero = lambda name: F.coalesce(name, F.lit(0))
    out = x.select("fault", "risk", zero("events_7d").alias("events_7d"), zero("events_30d").alias("events_30d"), F.round(F.coalesce("top", F.lit(0.0)), 1).alias("max_mag_7d"), F.round("kp", 1).alias("kp"), "dart_station", F.round("raised", 3).alias("dart_score"))
    return out.withColumn("place", F.expr("row_number() OVER (ORDER BY risk DESC, fault)"))
