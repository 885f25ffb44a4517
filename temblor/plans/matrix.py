"""The cell-hour matrix: what a zone's catalogue and the signals say at every hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_sql
from ..operators import cellhours
from ..operators.cellhours import RISE, SLACK, TAP
from .registry import query
from .series import HOURLY, ZONED, hourly, zoned

#: Degrees round a zone whose strong events count for its stress.
MARGIN = 2
B = "CASE WHEN {n} >= 15 AND {s} / {n} > 2.51 + 1e-9 THEN round(1 / (ln(10) * ({s} / {n} - 2.5)), 6) END"
LOG = "CASE WHEN {x} > 0 THEN round(log10({x} + {plus}), 6) ELSE 0 END"


def windows(expr: str, name: str, hours: tuple[int, ...], on: str = "true") -> str:
    return ", ".join(f"{expr} FILTER (age <= {w * 3600} AND {on}) AS {name}_{w}" for w in hours)


POWER, MOMENT = "sum(pow(10.0::DOUBLE, 1.5 * magnitude))", "sum(pow(10.0::DOUBLE, 1.5 * magnitude + 9.05))"
MATRIX = f"""{ZONED}, span AS (SELECT CAST(ceil(min(ep) / 3600) AS BIGINT) AS a, CAST(ceil(max(ep) / 3600) AS BIGINT) AS b FROM z),
g AS (SELECT zone, hour, hour - a AS place FROM (SELECT DISTINCT zone FROM z), span, (SELECT unnest(range(a, b + 1)) AS hour FROM span)),
j AS (SELECT g.zone, g.hour, event_id, ep, magnitude, depth_km, g.hour * 3600 - ep AS age FROM g JOIN z ON z.zone = g.zone AND ep <= g.hour * 3600),
s AS (SELECT zone, hour, {windows("count(*)", "n", (1, 6, 24, 72, 168, 720))}, {windows("count(*)", "n4", (24, 168), "magnitude >= 4")}, {windows(POWER, "energy", (24, 48))}, {windows(MOMENT, "moment", (168, 336, 720))},
  {windows("count(*)", "above", (336, 720), "magnitude >= 2.5")}, {windows("sum(magnitude)", "total", (336, 720), "magnitude >= 2.5")}, {windows("avg(depth_km)", "depth", (168,), "depth_km > 0")}, {windows("count(*)", "deep", (720,), "depth_km > 70")},
  {windows("max(magnitude)", "top", (72, 168))}, {windows("min(magnitude)", "low", (168,))}, max(ep) AS last FROM j GROUP BY 1, 2),
c AS (SELECT zone, 0.0::DOUBLE AS lat, -165.0::DOUBLE + zone * 30 AS lon FROM (SELECT DISTINCT zone FROM z)),
x AS (SELECT c.zone, q.ep, pow(10.0::DOUBLE, 1.5 * magnitude + 9.1) / pow(greatest(1, {haversine_sql("c", "q")}), 3) AS x FROM c JOIN quakes q ON magnitude >= 5 AND q.lon BETWEEN c.lon - {15 + MARGIN} AND c.lon + {15 + MARGIN}),
st AS (SELECT g.zone, g.hour, sum(x) AS stress FROM g JOIN x ON x.zone = g.zone AND ep <= g.hour * 3600 AND ep >= g.hour * 3600 - 1440 * 3600 GROUP BY 1, 2),
f AS (SELECT g.*, s.* EXCLUDE (zone, hour), stress, {B.format(n="above_336", s="total_336")} AS b14_, {B.format(n="above_720", s="total_720")} AS b30_, {LOG.format(x="energy_24", plus="1")} AS e24, {LOG.format(x="energy_48", plus="1")} AS e48,
  {LOG.format(x="moment_168", plus="0")} AS m7, {LOG.format(x="moment_336", plus="0")} AS m14, {LOG.format(x="moment_720", plus="0")} AS m30, {LOG.format(x="stress", plus="1e-30")} AS coulomb_proxy FROM g LEFT JOIN s USING (zone, hour) LEFT JOIN st USING (zone, hour)),
u AS (SELECT zone, round(coalesce(median(b14_), 1), 6) AS usual FROM f GROUP BY 1),
k AS (SELECT f.*, coalesce(b14_, usual) AS b14, coalesce(b30_, usual) AS b30, coalesce(n_6, 0) AS c6, coalesce(n_24, 0) AS c24 FROM f JOIN u USING (zone)),
t AS (SELECT *, row_number() OVER (PARTITION BY zone, hour ORDER BY ep, event_id) AS i FROM j WHERE age <= {168 * 3600}),
r AS (SELECT *, magnitude - lag(magnitude) OVER w AS step, lead(magnitude) OVER w AS m1, lead(magnitude, 2) OVER w AS m2 FROM t WINDOW w AS (PARTITION BY zone, hour ORDER BY i)),
q AS (SELECT *, sum(CASE WHEN magnitude < magnitude - step - {SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY zone, hour ORDER BY i) AS run FROM r),
l AS (SELECT zone, hour, max(n) AS longest FROM (SELECT zone, hour, run, count(*) AS n FROM q GROUP BY 1, 2, 3) GROUP BY 1, 2),
v AS (SELECT zone, hour, count(*) AS n, CASE WHEN count(*) >= 3 THEN max(magnitude) / median(magnitude) ELSE 0 END AS rumble, count(*) FILTER (abs(magnitude - m1) <= {TAP} AND m2 >= magnitude + {RISE}) AS taps, arg_min(i, struct_pack(m := -magnitude, i := i)) - 1 AS peak,
  CASE WHEN count(*) FILTER (age <= 259200) >= 3 THEN regr_slope(magnitude, i) FILTER (age <= 259200) ELSE 0 END AS trend FROM r GROUP BY 1, 2),
matrix AS (SELECT k.zone, k.hour, place, {", ".join(f"coalesce(n_{w}, 0) AS eq_count_{name}" for w, name in ((1, "1h"), (6, "6h"), (24, "24h"), (72, "72h"), (168, "7d"), (720, "30d")))}, coalesce(n4_24, 0) AS m4_count_24h, coalesce(n4_168, 0) AS m4_count_7d,
  round(c6 / (greatest(c24 - c6, 0) / 3 + 1), 6) AS foreshock_accel, round((coalesce(n_168, 0) / 7) / greatest(coalesce(n_720, 0) / 30, 0.01), 6) AS rate_anomaly_7d, b14 AS b_value_14d, b30 AS b_value_30d, round(b14 - b30, 6) AS b_delta, e24 AS energy_24h,
  round(e24 / (greatest(e48 - e24, 0.01) + 0.01), 5) AS energy_ratio, coalesce(top_72, 0) AS max_mag_72h, coalesce(top_168, 0) AS max_mag_7d, round(coalesce(top_168 - low_168, 0), 6) AS mag_range_7d, m7 AS moment_7d, m30 AS moment_30d, round(m7 / (greatest(m14 - m7, 0.01) + 0.01), 5) AS moment_accel,
  round(coalesce((k.hour * 3600 - last) / 3600, 720), 6) AS time_since_last, round(depth_168, 6) AS depth_mean_7d, round(CASE WHEN place < 671 THEN 0 ELSE regr_slope(b14, place) OVER (PARTITION BY k.zone ORDER BY k.hour ROWS BETWEEN 671 PRECEDING AND CURRENT ROW) END, 8) AS b_value_accel,
  coulomb_proxy, 0.0::DOUBLE AS omori_deficit, round(coalesce(deep_720, 0) / greatest(coalesce(n_720, 0), 1), 6) AS subduction_proxy, coalesce(c6 - 2 * lag(c6, 6) OVER h + lag(c6, 12) OVER h, 0) AS foreshock_curvature,
  CASE WHEN v.n >= 2 THEN longest ELSE 0 END AS seq_consec_up_7d, round(coalesce(rumble, 0), 6) AS seq_rumble_ratio_7d, round(coalesce(trend, 0), 6) AS seq_mag_trend_72h, coalesce(taps, 0) AS seq_double_tap_7d, CASE WHEN v.n >= 2 THEN peak ELSE 0 END AS seq_depth_to_peak_7d, round(coalesce(v.n / n_720, 0), 6) AS seq_active_ratio
  FROM k LEFT JOIN v ON v.zone = k.zone AND v.hour = k.hour LEFT JOIN l ON l.zone = k.zone AND l.hour = k.hour WINDOW h AS (PARTITION BY k.zone ORDER BY k.hour))"""
SIGNALS = f"""{HOURLY}, sig AS (SELECT o.hour, CAST(sum(CAST(v AS DECIMAL(18, 4))) FILTER (metric = 'view') AS DOUBLE) / count(v) FILTER (metric = 'view') / 11 AS kp_mean_72h, max(v) FILTER (metric = 'view') / 11 AS storm_kp_max_72h, -(CAST(sum(CAST(v AS DECIMAL(18, 4))) FILTER (metric = 'click') AS DOUBLE) / count(v) FILTER (metric = 'click')) AS dst_mean_72h, 10 * (CAST(sum(CAST(v AS DECIMAL(18, 4))) FILTER (metric = 'purchase') AS DOUBLE) / count(v) FILTER (metric = 'purchase')) AS sw_speed_mean_72h
  FROM (SELECT DISTINCT hour FROM g) o LEFT JOIN hourly h ON h.hour BETWEEN o.hour - 71 AND o.hour GROUP BY 1)"""


def centre():
    """The middle of a zone."""
    return F.struct(F.lit(0.0).alias("lat"), (-165.0 + F.col("zone") * 30).alias("lon"))


def margin(z):
    """Strong events of each zone and of the degrees round it: an event is in up to three zones."""
    near = F.array(*(F.col("zone") + k for k in (-1, 0, 1)))
    s = z.where("magnitude >= 5").select("ep", "magnitude", "lat", "lon", F.explode(near).alias("zone"))
    mid = centre()["lon"]
    return s.where(F.col("lon").between(mid - (15 + MARGIN), mid + (15 + MARGIN))).join(F.broadcast(z.select("zone").distinct()), "zone", "left_semi")


def matrix(spark, sf_dir):
    z = zoned(spark, sf_dir)
    return cellhours.matrix(z.select("zone", "event_id", "ep", "magnitude", "depth_km"), centre(), margin(z))


def signals(spark, sf_dir):
    """By hour: the means of 72 hours of the planetary index, the ring current and the wind, and the index's maximum."""
    s = cellhours.trailing_signal(hourly(spark, sf_dir), 72)
    of = lambda metric, column: F.max(F.when(F.col("metric") == metric, F.col(column)))
    return s.groupBy("hour").agg((of("view", "mean") / 11).alias("kp_mean_72h"), (of("view", "top") / 11).alias("storm_kp_max_72h"), (-of("click", "mean")).alias("dst_mean_72h"), (10 * of("purchase", "mean")).alias("sw_speed_mean_72h"))


@query(f"WITH {MATRIX} SELECT * FROM matrix")
def cell_hours(spark, sf_dir):
    """The catalogue's 34 columns for every zone and hour."""
    return matrix(spark, sf_dir)


@query(f"""WITH {MATRIX}, {SIGNALS}, m AS (SELECT matrix.*, kp_mean_72h, storm_kp_max_72h, dst_mean_72h, sw_speed_mean_72h FROM matrix LEFT JOIN sig USING (hour)),
d AS (SELECT *, {", ".join(f"CASE WHEN place >= 24 THEN round({e} - lag({e}, 24) OVER h, 6) ELSE 0 END AS {n}" for e, n in (("coulomb_proxy", "dc"), ("b_value_14d", "db"), ("foreshock_accel", "da"), ("eq_count_24h", "dn"), ("energy_24h", "de"), ("coalesce(dst_mean_72h, 0)", "dd")))} FROM m WINDOW h AS (PARTITION BY zone ORDER BY hour))
SELECT zone, hour, kp_mean_72h, storm_kp_max_72h, dst_mean_72h, sw_speed_mean_72h, dc AS v24_coulomb_proxy, CASE WHEN place >= 48 THEN round(dc - lag(dc, 24) OVER h, 6) ELSE 0 END AS acc_coulomb_proxy,
  CAST((b_value_14d < 0.8 AND db < 0) AS INT) + CAST(da > 0.5 AS INT) + CAST(dn > 2 AS INT) + CAST(de > 0.5 AS INT) + CAST(dc > 0 AS INT) + CAST((coalesce(dst_mean_72h, 0) < -30 AND dd < -5) AS INT) AS precursor_alarm,
  coalesce(kp_mean_72h, 0) * eq_count_24h AS kp_x_foreshock, abs(coalesce(dst_mean_72h, 0)) * greatest(1 - b_value_14d, 0) AS dst_x_bvalue, coalesce(sw_speed_mean_72h, 0) * foreshock_accel AS sw_x_accel, coalesce(sw_speed_mean_72h, 0) * abs(coulomb_proxy) AS sw_x_coulomb,
  coalesce(kp_mean_72h, 0) * moment_7d AS kp_x_moment, coalesce(storm_kp_max_72h, 0) * eq_count_24h AS storm_x_foreshock FROM d WINDOW h AS (PARTITION BY zone ORDER BY hour)""")
def cell_hour_velocity(spark, sf_dir):
    """Changes of the matrix, the precursor alarm, and products of signals and catalogue.  Signals are a row an hour (some megabytes a century), so they are sent to the cells."""
    m = matrix(spark, sf_dir).join(F.broadcast(signals(spark, sf_dir)), "hour", "left")
    names = ["kp_mean_72h", "storm_kp_max_72h", "dst_mean_72h", "sw_speed_mean_72h"]
    out = cellhours.interactions(cellhours.velocity(m))
    return out.select("zone", "hour", *names, "v24_coulomb_proxy", "acc_coulomb_proxy", "precursor_alarm", "kp_x_foreshock", "dst_x_bvalue", "sw_x_accel", "sw_x_coulomb", "kp_x_moment", "storm_x_foreshock")
