"""Features of cells at every hour of a grid: catalogue, sequences, velocity.

Events are summed by cell and hour once, before they are shuffled; what follows runs over the hours of a cell, whose number is
that of the time span whatever the number of events.  An hour's trailing window of n hours, both ends included, is the running sum at the hour
less the running sum n hours before, and the events exactly on that earlier hour, which are summed apart.  All running sums of a cell share
one exchange and one sort.

Shapes of sequences need the events one by one: these are dealt out by cell and week, each event to its own week and the next, and a week's
168 windows are slices of its sorted events in an Arrow kernel; the busiest week of a cell bounds a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine

HOUR, DAY_HOURS, WEEK = 3600, 24, 168
EXACT = "decimal(38,10)"
#: Completeness magnitude, least events and least excess of the mean for a b-value, hours without an event, depth of deep events in km.
MC, B_EVENTS, B_EXCESS, NONE_HOURS, DEEP_KM = 2.5, 15, 0.01 + 1e-9, 720.0, 70.0
#: Slack of a rise, closeness of a double tap, and the rise that ends it.
SLACK, TAP, RISE = 0.05 + 1e-6, 0.3 + 1e-6, 1.0 - 1e-6


def at_hour(ep: Column) -> Column:
    """The first hour of the grid that has the event in its past."""
    return F.ceil(ep / HOUR).cast("long")


def grid(events: DataFrame) -> DataFrame:
    """zone and hour: every hour from the first to the last of all events, for each zone that has some."""
    span = events.agg(at_hour(F.min("ep")).alias("a"), at_hour(F.max("ep")).alias("b"))
    return events.select("zone").distinct().join(F.broadcast(span)).select("zone", F.explode(F.sequence("a", "b")).alias("hour"))


def hour_sums(events: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """zone, hour, each sum over the hour's events and, as ``{name}_on``, over those exactly on the hour; the least, greatest and last."""
    on = F.col("ep") == F.col("hour") * HOUR
    e = events.withColumn("hour", at_hour(F.col("ep")))
    m = F.col("magnitude")
    return e.groupBy("zone", "hour").agg(
        *(F.sum(c).alias(n) for n, c in sums.items()), *(F.sum(F.when(on, c)).alias(f"{n}_on") for n, c in sums.items()),
        F.max(m).alias("top"), F.min(m).alias("low"), F.max(F.when(on, m)).alias("top_on"), F.min(F.when(on, m)).alias("low_on"), F.max("ep").alias("last"),
    )


def trailing(hours: DataFrame, windows: dict[str, list[int]]) -> DataFrame:
    """``hours`` (a row for each zone and hour) with ``{name}_{n}``: the sum over the trailing n hours, for each name and its windows."""
    by = Window.partitionBy("zone").orderBy("hour")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda c: F.coalesce(c, F.lit(0))
    hours = hours.withColumns({f"{n}_run": zero(F.sum(n).over(so_far)) for n in windows})
    before = lambda c, n: zero(F.lag(c, n).over(by))
    return hours.withColumns({f"{n}_{w}": F.col(f"{n}_run") - before(f"{n}_run", w) + before(f"{n}_on", w) for n, ws in windows.items() for w in ws})


def b_value(n: Column, total: Column) -> Column:
    mean = total.cast("double") / n
    return F.when((n >= B_EVENTS) & (mean > MC + B_EXCESS), F.round(1 / (F.log(F.lit(10.0)) * (mean - MC)), 6))


def rolling_slope(value: str, n: int, by: Window) -> Column:
    """Slope of the last n values of a dense series over their place, from running sums; 0 before there are n."""
    k = F.col("place")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s, u = (F.sum(x).over(so_far) for x in (F.col(value), F.col(value) * k))
    back = by.rowsBetween(Window.unboundedPreceding, -n)
    s0, u0 = (F.coalesce(F.sum(x).over(back), F.lit(0.0)) for x in (F.col(value), F.col(value) * k))
    total, steps = s - s0, n * (n - 1) / 2
    ty = (u - u0) - (k - (n - 1)) * total
    return F.when(k < n - 1, 0.0).otherwise((n * ty - steps * total) / (n * n * (n * n - 1) / 12.0))


def catalogue(events: DataFrame, centre: Column, margin: DataFrame) -> DataFrame:
    """The catalogue block.  ``events`` has zone, event_id, ep, magnitude and depth_km; ``margin`` the strong events of each zone and its surroundings, with lat and lon;
    ``centre`` is (lat, lon) of a zone, as a struct made of zone."""
    m, d = F.col("magnitude"), F.col("depth_km")
    power = lambda plus: F.pow(F.lit(10.0), 1.5 * m + plus).cast(EXACT)
    above = m >= MC
    sums = {
        "n": F.lit(1), "n4": (m >= 4).cast("int"), "energy": power(0), "moment": power(9.05), "above": above.cast("int"), "total": F.when(above, m).cast(EXACT),
        "known": (d > 0).cast("int"), "depth": F.when(d > 0, d).cast(EXACT), "deep": (d > DEEP_KM).cast("int"),
    }
    apart = F.greatest(F.lit(1.0), haversine(centre["lat"], centre["lon"], F.col("lat"), F.col("lon")))
    stress = margin.select("zone", at_hour(F.col("ep")).alias("hour"), (F.col("ep") == at_hour(F.col("ep")) * HOUR).alias("on"), (F.pow(F.lit(10.0), 1.5 * m + 9.1) / F.pow(apart, 3)).cast(EXACT).alias("x"))
    stress = stress.groupBy("zone", "hour").agg(F.sum("x").alias("stress"), F.sum(F.when(F.col("on"), F.col("x"))).alias("stress_on"))
    h = grid(events).join(hour_sums(events, sums), ["zone", "hour"], "left").join(stress, ["zone", "hour"], "left")
    by = Window.partitionBy("zone").orderBy("hour")
    h = h.withColumn("place", F.row_number().over(by) - 1)
    h = trailing(h, {"n": [1, 6, 24, 72, WEEK, 720], "n4": [24, WEEK], "energy": [24, 48], "moment": [WEEK, 336, 720], "above": [336, 720], "total": [336, 720], "known": [WEEK], "depth": [WEEK], "deep": [720], "stress": [1440]})
    c = F.col
    edge = lambda fn, of, n: (F.greatest if fn is F.max else F.least)(fn(of).over(by.rowsBetween(-(n - 1), 0)), F.lag(f"{of}_on", n).over(by))
    log = lambda x, plus=0.0: F.when(x > 0, F.round(F.log10(x.cast("double") + plus), 6)).otherwise(0.0)
    h = h.withColumns({
        "b14": b_value(c("above_336"), c("total_336")), "b30": b_value(c("above_720"), c("total_720")), "max_72": edge(F.max, "top", 72), "max_7d": edge(F.max, "top", WEEK), "min_7d": edge(F.min, "low", WEEK),
        "since": F.max("last").over(by.rowsBetween(Window.unboundedPreceding, 0)), "e24": log(c("energy_24"), 1.0), "e48": log(c("energy_48"), 1.0), "m7": log(c("moment_168")), "m14": log(c("moment_336")), "m30": log(c("moment_720")),
        "coulomb_proxy": log(c("stress_1440"), 1e-30), "accel": F.round(c("n_6") / (F.greatest(c("n_24") - c("n_6"), F.lit(0)) / 3 + 1), 6),
    })
    usual = F.coalesce(F.percentile("b14", 0.5).over(Window.partitionBy("zone")), F.lit(1.0))
    h = h.withColumn("usual", F.round(usual, 6)).withColumns({"b14": F.coalesce("b14", "usual"), "b30": F.coalesce("b30", "usual")})
    rest = lambda x: F.greatest(x, F.lit(0.01)) + 0.01
    late = lambda x, n: F.lag(x, n).over(by)
    return h.select(
        "zone", "hour", "place", *(c(f"n_{w}").alias(f"eq_count_{name}") for w, name in ((1, "1h"), (6, "6h"), (24, "24h"), (72, "72h"), (WEEK, "7d"), (720, "30d"))), c("n4_24").alias("m4_count_24h"), c("n4_168").alias("m4_count_7d"),
        c("accel").alias("foreshock_accel"), F.round((c("n_168") / 7) / F.greatest(c("n_720") / 30, F.lit(0.01)), 6).alias("rate_anomaly_7d"), c("b14").alias("b_value_14d"), c("b30").alias("b_value_30d"), F.round(c("b14") - c("b30"), 6).alias("b_delta"),
        c("e24").alias("energy_24h"), F.round(c("e24") / rest(c("e48") - c("e24")), 5).alias("energy_ratio"), F.coalesce("max_72", F.lit(0.0)).alias("max_mag_72h"), F.coalesce("max_7d", F.lit(0.0)).alias("max_mag_7d"), F.round(F.coalesce(c("max_7d") - c("min_7d"), F.lit(0.0)), 6).alias("mag_range_7d"),
        c("m7").alias("moment_7d"), c("m30").alias("moment_30d"), F.round(c("m7") / rest(c("m14") - c("m7")), 5).alias("moment_accel"), F.round(F.coalesce((c("hour") * HOUR - c("since")) / HOUR, F.lit(NONE_HOURS)), 6).alias("time_since_last"),
        F.round(F.when(c("known_168") > 0, c("depth_168").cast("double") / c("known_168")), 6).alias("depth_mean_7d"), F.round(rolling_slope("b14", 4 * WEEK, by), 8).alias("b_value_accel"), "coulomb_proxy", F.lit(0.0).alias("omori_deficit"),
        F.round(c("deep_720") / F.greatest(c("n_720"), F.lit(1)), 6).alias("subduction_proxy"), F.coalesce(c("n_6") - 2 * late("n_6", 6) + late("n_6", 12), F.lit(0)).alias("foreshock_curvature"),
    )


SHAPES = "zone {zone}, hour long, seq_consec_up_7d long, seq_rumble_ratio_7d double, seq_mag_trend_72h double, seq_double_tap_7d long, seq_depth_to_peak_7d long, n long"


def shape(m: np.ndarray) -> tuple[int, float, int, int]:
    """Longest run that does not fall, strongest over median, double taps, and the place of the strongest, of magnitudes in order of time."""
    n = len(m)
    if n < 2:
        return 0, 0.0, 0, 0
    falls = np.flatnonzero(m[1:] < m[:-1] - SLACK) + 1
    longest = int(np.diff(np.concatenate([[0], falls, [n]])).max())
    middle = float(np.median(m)) if n >= 3 else 0.0
    taps = int(((np.abs(m[:-2] - m[1:-1]) <= TAP) & (m[2:] >= m[:-2] + RISE)).sum()) if n >= 3 else 0
    return longest, float(m.max()) / middle if middle > 0 else 0.0, taps, int(m.argmax())


def trend(m: np.ndarray) -> float:
    if len(m) < 3:
        return 0.0
    x = np.arange(len(m)) - (len(m) - 1) / 2
    return float((x * (m - m.mean())).sum() / (x * x).sum())


def sequence_shapes(events: DataFrame) -> DataFrame:
    """zone, hour and the shapes of the events of the seven days before, for the hours that have some."""
    hour = at_hour(F.col("ep"))
    week = F.floor(hour / WEEK)
    # A window reaches back one week: into the event's own week and the one before.
    posted = events.select("zone", "ep", "event_id", "magnitude", F.explode(F.array(week, week + 1)).alias("week"))
    kind = events.schema["zone"].dataType.simpleString()

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("ep", "ascending"), ("event_id", "ascending")])
        t, m = group["ep"].to_numpy(), group["magnitude"].to_numpy()
        hours = np.arange(key[1].as_py() * WEEK, (key[1].as_py() + 1) * WEEK)
        to = np.searchsorted(t, hours * HOUR, "right")
        since, since3 = (np.searchsorted(t, (hours - n) * HOUR, "left") for n in (WEEK, 72))
        out = [(int(h), *shape(m[a:b]), trend(m[c:b]), int(b - a)) for h, a, c, b in zip(hours, since, since3, to, strict=True) if b > a]
        cols = list(zip(*out, strict=True)) or [()] * 7
        names = ("hour", "seq_consec_up_7d", "seq_rumble_ratio_7d", "seq_double_tap_7d", "seq_depth_to_peak_7d", "seq_mag_trend_72h", "n")
        found = dict(zip(names, cols, strict=True)) | {"zone": [key[0].as_py()] * len(out)}
        kinds = {"seq_rumble_ratio_7d": pa.float64(), "seq_mag_trend_72h": pa.float64(), "zone": group.schema.field("zone").type}
        order = [c.split()[0] for c in SHAPES.split(", ")]
        return pa.table({n: pa.array(found[n], kinds.get(n, pa.int64())) for n in order})

    return posted.groupBy("zone", "week").applyInArrow(run, SHAPES.format(zone=kind))


def matrix(events: DataFrame, centre: Column, margin: DataFrame) -> DataFrame:
    """The 34 columns of the catalogue for every zone and hour, sequences included."""
    zero = lambda n, digits: F.round(F.coalesce(F.col(n), F.lit(0)), digits).alias(n)
    h = catalogue(events, centre, margin).join(sequence_shapes(events), ["zone", "hour"], "left")
    seq = [zero("seq_consec_up_7d", 0), zero("seq_rumble_ratio_7d", 6), zero("seq_mag_trend_72h", 6), zero("seq_double_tap_7d", 0), zero("seq_depth_to_peak_7d", 0), F.round(F.when(F.col("n") > 0, F.col("n") / F.col("eq_count_30d")).otherwise(0.0), 6).alias("seq_active_ratio")]
    return h.select(*[c for c in h.columns if not c.startswith("seq_") and c != "n"], *seq)


#: Fixed values of the precursor alarm: b-value, and the day's changes of acceleration, count and energy; level and change of the ring current.
LOW_B, MORE_ACCEL, MORE_EVENTS, MORE_ENERGY, RING, RING_FALL = 0.8, 0.5, 2, 0.5, -30.0, -5.0


def velocity(h: DataFrame) -> DataFrame:
    """The day's change of the stress proxy, the change of that, and how many of the indicators are on at once; h has the matrix, place and dst_mean_72h (null: not there)."""
    by = Window.partitionBy("zone").orderBy("hour")
    day = lambda name: F.when(F.col("place") >= 24, F.round(F.col(name) - F.lag(name, 24).over(by), 6)).otherwise(0.0)
    names = ("coulomb_proxy", "b_value_14d", "foreshock_accel", "eq_count_24h", "energy_24h", "dst")
    h = h.withColumn("dst", F.coalesce("dst_mean_72h", F.lit(0.0)))
    h = h.withColumns({f"d_{n}": day(n) for n in names})
    c = F.col
    on = [
        (c("b_value_14d") < LOW_B) & (c("d_b_value_14d") < 0), c("d_foreshock_accel") > MORE_ACCEL, c("d_eq_count_24h") > MORE_EVENTS, c("d_energy_24h") > MORE_ENERGY, c("d_coulomb_proxy") > 0, (c("dst") < RING) & (c("d_dst") < RING_FALL),
    ]
    acc = F.when(c("place") >= 48, F.round(c("d_coulomb_proxy") - F.lag("d_coulomb_proxy", 24).over(by), 6)).otherwise(0.0)
    h = h.withColumns({"v24_coulomb_proxy": c("d_coulomb_proxy"), "acc_coulomb_proxy": acc, "precursor_alarm": sum(x.cast("int") for x in on)})
    return h.drop("dst", *(f"d_{n}" for n in names))


def trailing_signal(hourly: DataFrame, hours: int) -> DataFrame:
    """metric, hour, and the mean and maximum of the hourly values (hour, v, of four decimals) of the last ``hours``: each hour is posted to the hours that it is in the past of, and combined before the shuffle."""
    posted = hourly.select("metric", "v", F.explode(F.sequence(F.col("hour"), F.col("hour") + (hours - 1))).alias("hour"))
    return posted.groupBy("metric", "hour").agg((F.sum(F.col("v").cast("decimal(18,4)")).cast("double") / F.count("v")).alias("mean"), F.max("v").alias("top"))


def interactions(h: DataFrame) -> DataFrame:
    """Products of signals and catalogue columns; what is null counts as 0."""
    v = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    low_b = F.greatest(1 - v("b_value_14d"), F.lit(0.0))
    out = {
        "kp_x_foreshock": v("kp_mean_72h") * v("eq_count_24h"), "dst_x_bvalue": F.abs(v("dst_mean_72h")) * low_b, "sw_x_accel": v("sw_speed_mean_72h") * v("foreshock_accel"), "sw_x_coulomb": v("sw_speed_mean_72h") * F.abs(v("coulomb_proxy")),
        "kp_x_moment": v("kp_mean_72h") * v("moment_7d"), "storm_x_foreshock": v("storm_kp_max_72h") * v("eq_count_24h"),
    }
    return h.withColumns(out)
