"""Signals of stations: tides taken out by least squares, triggers of short over long means, spectra.

Least squares need only sums of products, one row a station; what follows from the residuals are aggregates.  Means over a number of samples
are differences of running sums within blocks of samples, each of which also has the samples before it that its windows reach back to.
Triggers with a pause between them are a chain from each station's first: every trigger points to the first one after its pause, and the chain is
found by doubling the pointers, so that no station is gone through in one task.  Spectra are an Arrow kernel over blocks of windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

HOUR = 3600
#: Periods of the tide in hours, and the least number of readings of a fit.
TIDES = (12.42, 12.00, 23.93, 25.82, 6.21)
READINGS = 48


# Tides


def harmonic_terms(hours: Column) -> list[Column]:
    """1, the time in weeks, and a sine and cosine of each tide."""
    waves = [f(2 * math.pi * hours / period) for period in TIDES for f in (F.sin, F.cos)]
    return [F.lit(1.0), hours / 168, *waves]


def solve(sums: DataFrame, n: int) -> DataFrame:
    """station and ``fit``, the n coefficients, of rows (station, gram: the upper triangle of sums of products by rows, rhs); one small system a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.triu_indices(n)
        for batch in batches:
            out = []
            for gram, rhs in zip(batch.column("gram"), batch.column("rhs"), strict=True):
                a = np.zeros((n, n))
                a[at] = gram.values.to_numpy()
                a = a + np.triu(a, 1).T
                out.append(np.linalg.lstsq(a, rhs.values.to_numpy(), rcond=None)[0])
            yield pa.RecordBatch.from_arrays([batch.column("station"), pa.array(out, pa.list_(pa.float64()))], names=["station", "fit"])

    return sums.mapInArrow(run, f"station {sums.schema['station'].dataType.simpleString()}, fit array<double>")


def detrended(readings: DataFrame, seconds: int = 7 * 86400) -> DataFrame:
    """Readings (station, t, mode, height, and others) of each station's last ``seconds`` with ``now``, the station's last time, and ``mm``, what the normal ones
    (mode 1) are off the tides and a straight line, in millimetres.  Stations with fewer than READINGS of either kind are left out.

    Each station is fitted by sums over its readings; the fits (a few numbers a station) are joined back."""
    now = readings.groupBy("station").agg(F.max("t").alias("now"))
    near = readings.join(now, "station").where(F.col("t") >= F.col("now") - seconds)
    normal = F.col("mode") == 1
    known = near.groupBy("station").agg(F.count("*").alias("n"), F.count_if(normal).alias("n_normal"), F.min(F.when(normal, F.col("t"))).alias("t0"), F.min(F.when(normal, F.col("height"))).alias("h0"))
    known = known.where((F.col("n") >= READINGS) & (F.col("n_normal") >= READINGS)).select("station", "t0", "h0")
    # Heights count from the station's lowest, since the sums lose what is small beside the greatest.
    near = near.join(known, "station").withColumn("h", F.col("height") - F.col("h0"))
    terms = harmonic_terms((F.col("t") - F.col("t0")) / HOUR)
    n = len(terms)
    rows = near.where(normal).select("station", "h", *(x.alias(f"x{i}") for i, x in enumerate(terms)))
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(n) for j in range(i, n)]
    sums = rows.groupBy("station").agg(F.array(*products).alias("gram"), F.array(*(F.sum(F.col(f"x{i}") * F.col("h")) for i in range(n))).alias("rhs"))
    fitted = near.join(solve(sums, n), "station")
    tide = sum((F.col("fit")[i] * x for i, x in enumerate(terms)), F.lit(0.0))
    return fitted.withColumn("mm", F.when(normal, (F.col("h") - tide) * 1000)).drop("fit", "t0", "h0", "h")


def residual_features(d: DataFrame) -> DataFrame:
    """By station: means, spreads, slopes, ramps and swings of the residuals, and counts of readings of other modes.  ``d`` has station, now, t, mode, mm and k, the place
    of normal readings in order; slopes are over places, times the readings a day."""
    age = F.col("now") - F.col("t")
    mm = F.col("mm")
    # Ages from and up to which, in hours: the older end belongs to the span.
    span = lambda old, young=None: mm.isNotNull() & (age <= old * HOUR) & (F.lit(True) if young is None else age > young * HOUR)
    n = lambda on: F.count_if(on)
    of = lambda fn, on: fn(F.when(on, mm))
    slope = lambda on: F.regr_slope(F.when(on, mm), F.when(on, F.col("k")).cast("double"))
    last6, last12, last24, last48 = (span(h) for h in (6, 12, 24, 48))
    prior, wide, early = span(24, 6), span(36, 12), span(72, 48)
    other = F.col("mode").isin(2, 3)
    late = lambda h: F.count_if(other & (age <= h * HOUR))
    ends = lambda fn: fn(F.when(last6, mm), F.when(last6, F.col("k")))
    first, second = mm.isNotNull() & (age > 96 * HOUR), span(96)
    with_n = lambda on, least, x: F.when(n(on) > least, x)
    t12, t_wide = slope(last12) * n(last12) / 0.5, slope(wide) * n(wide)
    r = lambda x, name: F.round(x, 4).alias(name)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return d.groupBy("station").agg(
        r(zero(of(F.avg, last24)), "residual_mean_24h"), r(zero(of(F.stddev_pop, last24)), "residual_std_24h"), r(zero(with_n(last48, 4, slope(last48) * n(last48) / 2)), "residual_trend_48h"),
        r(zero(with_n(last6, 1, (ends(F.max_by) - ends(F.min_by)) / 6)), "rate_of_change_6h"), r(zero(of(F.avg, second) - of(F.avg, first)), "loading_index"),
        r(zero(F.when((n(early) > 4) & (n(last48) > 4), (slope(last48) - slope(early)) * n(early))), "trend_reversal"),
        r(F.when((n(last6) > 2) & (n(prior) > 2), of(F.stddev_pop, last6) / F.greatest(F.lit(0.01), of(F.stddev_pop, prior))), "vol_ramp_6v18"),
        r(F.when((n(last12) > 2) & (n(wide) > 2), of(F.stddev_pop, last12) / F.greatest(F.lit(0.01), of(F.stddev_pop, wide))), "vol_ramp_12v36"),
        r(with_n(last6, 2, of(F.stddev_pop, last6)), "std_6h"), r(with_n(last12, 2, of(F.stddev_pop, last12)), "std_12h"), r(with_n(last12, 4, t12), "trend_12h"), r(with_n(last6, 3, slope(last6) * n(last6) / 0.25), "trend_6h"),
        r(F.when((n(last12) > 4) & (n(wide) > 4), t12 - t_wide), "trend_accel"), F.count_if(other).alias("event_mode_7d"), late(24).alias("event_mode_24h"), late(12).alias("event_mode_12h"), late(6).alias("event_mode_6h"),
        r(late(12) / F.greatest(F.lit(1), F.count_if(other) - late(24)), "event_mode_accel"),
    )


# Triggers


def short_over_long(samples: DataFrame, short: int, long: int, block: int = 4096) -> DataFrame:
    """samples (station, k, amplitude: whole numbers, and others; k from 0 without gaps) with ``ratio``, the mean of the last ``short`` over that of the last ``long``
    absolute amplitudes; rows before there are ``long``, and where the long mean is 0, have none.  ``block`` is ``long`` at least."""
    block = max(block, long)
    at = F.floor(F.col("k") / block)
    # The end of a block is also the past of the next one.
    tail = F.col("k") % block >= block - long
    posted = samples.withColumn("__block", F.explode(F.when(tail, F.array(at, at + 1)).otherwise(F.array(at))))
    by = Window.partitionBy("station", "__block").orderBy("k")
    total = F.sum(F.abs("amplitude").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    posted = posted.withColumn("__sum", total)
    last = lambda n: F.col("__sum") - F.coalesce(F.lag("__sum", n).over(by), F.lit(0))
    rows = posted.withColumns({"__short": last(short), "__long": last(long)}).where(F.floor(F.col("k") / block) == F.col("__block"))
    ratio = F.when((F.col("k") >= long - 1) & (F.col("__long") > 0), (F.col("__short") / short) / (F.col("__long") / long))
    return rows.withColumn("ratio", ratio).drop("__block", "__sum", "__short", "__long")


def with_pause(triggers: DataFrame, pause: int) -> DataFrame:
    """Of triggers (station, k, t), t whole seconds, those that a detector takes that takes the first and then the next one later than ``pause`` after the last taken.

    A trigger's next one is in the slot of time (as long as the pause) where its pause ends, or the first of a later slot: slots have their rows in one task, stations don't.
    Each round makes the pointers twice as long and takes what the triggers taken so far point to."""
    slot = lambda t: F.floor(t / (pause + 1)).cast("long")
    rows = triggers.select("station", "k", "t", F.struct("t", "k").alias("me"), slot(F.col("t")).alias("slot"))
    # A question stands at the end of the pause; what it asks for is the first trigger from there on.
    asks = rows.select("station", F.col("me").alias("asker"), (F.col("t") + pause + 1).alias("t")).withColumn("slot", slot(F.col("t")))
    both = rows.select("station", "slot", "t", "me", F.lit(None).cast(asks.schema["asker"].dataType).alias("asker")).unionByName(asks, allowMissingColumns=True)
    within = Window.partitionBy("station", "slot").orderBy(F.desc("t"), F.col("asker").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("next", F.min("me").over(within)).where("asker is not null")
    firsts = rows.groupBy("station", "slot").agg(F.min("me").alias("first"))
    later = Window.partitionBy("station").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = both.select("station", "slot").union(firsts.select("station", "slot")).distinct().join(firsts, ["station", "slot"], "left")
    slots = slots.select("station", "slot", F.last("first", ignorenulls=True).over(later).alias("later"))
    jump = both.join(slots, ["station", "slot"]).select("station", F.col("asker").alias("me"), F.coalesce("next", "later").alias("to"))
    jump = checkpointed(jump.where("to is not null"))
    taken = checkpointed(rows.groupBy("station").agg(F.min("me").alias("me")))
    while not jump.isEmpty():
        reached = taken.join(jump, ["station", "me"]).select("station", F.col("to").alias("me"))
        taken = checkpointed(taken.union(reached).distinct())
        then = jump.select("station", F.col("me").alias("to"), F.col("to").alias("far"))
        jump = checkpointed(jump.join(then, ["station", "to"]).select("station", "me", F.col("far").alias("to")))
    return triggers.join(taken.select("station", F.col("me.t").alias("t"), F.col("me.k").alias("k")), ["station", "t", "k"], "left_semi")


# Spectra


def band_pass(low: float, high: float, rate: float, order: int = 4) -> list[np.ndarray]:
    """Second-order sections (b0 b1 b2 a1 a2) of a Butterworth band pass: poles of the prototype, moved to the band, by the bilinear transform."""
    warp = [2 * rate * math.tan(math.pi * f / rate) for f in (low, high)]
    width, middle = warp[1] - warp[0], math.sqrt(warp[0] * warp[1])
    prototype = [np.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    poles = []
    for p in prototype:
        half = p * width / 2
        root = np.sqrt(half * half - middle * middle + 0j)
        poles += [half + root, half - root]
    poles = [(2 * rate + p) / (2 * rate - p) for p in poles]
    pairs = sorted((p for p in poles if p.imag > 0), key=abs)
    sections = [np.array([1.0, 0.0, -1.0, -2 * p.real, abs(p) ** 2]) for p in pairs]
    # Gain 1 in the middle of the band, shared by the sections.
    z = np.exp(2j * math.pi * math.atan(middle / (2 * rate)) / math.pi)
    for s in sections:
        s[:3] /= abs((1 - z**-2) / (1 + s[3] / z + s[4] / z**2))
    return sections


def filtered(x: np.ndarray, sections: list[np.ndarray]) -> np.ndarray:
    """Rows of x through the sections, all rows at once, sample by sample."""
    y = np.array(x, np.float64).T
    for b0, b1, b2, a1, a2 in sections:
        one = two = np.zeros(y.shape[1])
        out = np.empty_like(y)
        for k, v in enumerate(y):
            out[k] = b0 * v + one
            one, two = b1 * v - a1 * out[k] + two, b2 * v - a2 * out[k]
        y = out
    return y.T


def power_in_band(x: np.ndarray, rate: float, low: float, high: float, butterworth: bool) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power of each row of x) in the band: mean taken off, Hann window, band pass if wanted, real transform."""
    n = x.shape[1]
    x = (x - x.mean(1, keepdims=True)) * np.hanning(n)
    if butterworth:
        x = filtered(x, band_pass(low, high, rate))
    f = np.fft.rfftfreq(n, 1 / rate)
    keep = (f >= low) & (f <= high)
    return f[keep], np.abs(np.fft.rfft(x, axis=1)[:, keep]) ** 2 / n


def spectra(samples: DataFrame, rate: float, seconds: int = 600, hop: int = 300, low: float = 0.002, high: float = 0.020, butterworth: bool = True, windows: int = 16) -> DataFrame:
    """station, w (number of the window), f (hertz) and power of every window of ``seconds`` at every ``hop`` of samples (station, k from 0 without gaps, x).

    ``windows`` windows of a station are one block with all their samples, and a task holds a block: the samples of a block's end go to the next one too."""
    size, step = int(seconds * rate), int(hop * rate)
    span = windows * step
    first = F.greatest(F.lit(0), F.floor((F.col("k") - size + 1) / span)).cast("long")
    posted = samples.select("station", "k", "x", F.explode(F.sequence(first, F.floor(F.col("k") / span).cast("long"))).alias("block"))
    kind = samples.schema["station"].dataType.simpleString()

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        k, x = group["k"].to_numpy(), group["x"].to_numpy()
        begin = key[1].as_py() * span
        starts = [s for s in range(begin, begin + span, step) if len(k) and s >= k[0] and s + size - 1 <= k[-1]]
        rows = {"station": [], "w": [], "f": [], "power": []}
        if starts:
            f, p = power_in_band(np.stack([x[s - k[0] : s - k[0] + size] for s in starts]), rate, low, high, butterworth)
            rows = {"station": [key[0].as_py()] * p.size, "w": np.repeat([s // step for s in starts], len(f)), "f": np.tile(f, len(starts)), "power": p.ravel()}
        return pa.table({"station": pa.array(rows["station"], group.schema.field("station").type), "w": pa.array(rows["w"], pa.int64()), "f": pa.array(rows["f"], pa.float64()), "power": pa.array(rows["power"], pa.float64())})

    return posted.groupBy("station", "block").applyInArrow(run, f"station {kind}, w long, f double, power double")


def resonance(found: DataFrame, least: int = 3) -> DataFrame:
    """By window: number of stations, the peak of their mean spectrum and its centroid in millihertz, and the logarithm of its power; windows of fewer than ``least`` stations are left out."""
    stack = found.groupBy("w", "f").agg(F.avg("power").alias("p"), F.count("*").alias("stations"))
    return stack.groupBy("w").agg(
        F.max("stations").alias("stations"), F.round(F.max_by("f", F.struct("p", -F.col("f"))) * 1000, 3).alias("peak_mhz"), F.round(F.log10(F.sum("p") + 1e-30), 4).alias("log_power"), F.round(F.sum(F.col("f") * F.col("p")) / F.sum("p") * 1000, 3).alias("centroid_mhz"),
    ).where(F.col("stations") >= least)
