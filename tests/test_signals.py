"""Signal functions and order by blocks, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def ordered_rows(spark):
    r = random.Random(3)
    rows = [(r.choice((1, 2, None)), i, float(r.randrange(0, 400)), r.choice((None, float(i)))) for i in range(200)]
    return rows, spark.createDataFrame(rows, "key long, id long, t double, v double")


def test_numbered_and_carried(spark):
    from temblor.operators.ordered import carried, numbered

    rows, df = ordered_rows(spark)
    order = lambda key: sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1]))
    block = F.floor(F.col("t") / 50)
    got = {x.id: x.k for x in numbered(df, ["key"], ["t", "id"], block).collect()}
    assert got == {x[1]: k for key in (1, 2, None) for k, x in enumerate(order(key))}
    for own in (True, False):
        want = {}
        for key in (1, 2, None):
            last = None
            for x in order(key):
                want[x[1]] = (last if x[3] is None else x[3]) if own else last
                last = last if x[3] is None else x[3]
        assert {x.id: x.b for x in carried(df, ["key"], ["t", "id"], "v", block, "b", own).collect()} == want
    assert numbered(df.limit(0), ["key"], ["t"], block).count() == 0


def test_tides_are_taken_out(spark):
    from temblor.operators import signals

    r = random.Random(5)
    tide = lambda h: 0.8 * math.sin(2 * math.pi * h / 12.42) + 0.3 * math.cos(2 * math.pi * h / 23.93) + 0.001 * h
    rows = []
    for station, noise in ((1, 0.0), (2, 0.05)):
        rows += [(station, i * 1800, 1, 5000.0 + tide(i / 2) + r.uniform(-noise, noise)) for i in range(400)]
    rows += [(1, 399 * 1800, 2, 9999.0), (3, 0, 1, 1.0)]
    df = spark.createDataFrame(rows, "station long, t long, mode int, height double")
    got = signals.detrended(df).collect()
    assert {x.station for x in got} == {1, 2} and all(x.t >= x.now - 7 * 86400 for x in got)  # a station of one reading has no fit
    assert all(x.mm is None for x in got if x.mode == 2) and max(abs(x.mm) for x in got if x.station == 1 and x.mode == 1) < 1e-4
    mine = sorted((x.t, x.height, x.mm) for x in got if x.station == 2)
    hours = (np.array([t for t, _, _ in mine]) - mine[0][0]) / 3600
    a = np.stack([np.ones_like(hours), hours, *(f(2 * np.pi * hours / p) for p in signals.TIDES for f in (np.sin, np.cos))], 1)
    h = np.array([x for _, x, _ in mine])
    want = (h - a @ np.linalg.lstsq(a, h, rcond=None)[0]) * 1000
    assert np.allclose([x for _, _, x in mine], want, atol=1e-4)


@pytest.mark.parametrize("block", [50, 64, 4096])
def test_short_over_long(spark, block):
    from temblor.operators.signals import short_over_long

    r = random.Random(block)
    x = {s: [r.choice((0, 1, -5, 40)) for _ in range(n)] for s, n in ((1, 300), (2, 49), (3, 51))} | {4: [0] * 60}
    df = spark.createDataFrame([(s, k, a) for s, xs in x.items() for k, a in enumerate(xs)], "station long, k long, amplitude long")
    got = {(w.station, w.k): w.ratio for w in short_over_long(df, 2, 50, block).collect()}
    assert len(got) == sum(map(len, x.values()))
    for (s, k), ratio in got.items():
        long = sum(map(abs, x[s][max(0, k - 49) : k + 1])) / 50
        assert ratio == (sum(map(abs, x[s][k - 1 : k + 1])) / 2 / long if k >= 49 and long else None)


def test_triggers_with_a_pause_are_the_one_by_one_order(spark):
    from temblor.operators.signals import with_pause

    r = random.Random(9)
    rows = [(s, k, t) for s, n, span in ((1, 200, 4000), (2, 60, 100_000), (3, 1, 10), (4, 80, 300)) for k, t in enumerate(sorted(r.randrange(span) for _ in range(n)))]
    want = []
    for s in (1, 2, 3, 4):
        last = None
        for _, k, t in (x for x in rows if x[0] == s):
            if last is None or t - last > 120:
                want.append((s, k, t))
                last = t
    df = spark.createDataFrame(rows, "station long, k long, t long")
    assert sorted(map(tuple, with_pause(df, 120).select("station", "k", "t").collect())) == want
    assert with_pause(df.limit(0), 120).count() == 0


def test_band_pass_is_a_butterworth_filter():
    from temblor.operators.signals import band_pass, filtered

    sections = band_pass(0.002, 0.020, 5.0)

    def gain(f):
        z = np.exp(2j * math.pi * f / 5.0)
        return abs(np.prod([(s[0] + s[1] / z + s[2] / z**2) / (1 + s[3] / z + s[4] / z**2) for s in sections]))

    assert abs(gain(0.002) - math.sqrt(0.5)) < 1e-6 and abs(gain(0.020) - math.sqrt(0.5)) < 1e-6 and abs(gain(math.sqrt(0.002 * 0.020)) - 1) < 1e-3
    assert gain(0.0005) < 1e-2 and gain(0.2) < 1e-3 and all(abs(np.roots([1, s[3], s[4]])).max() < 1 for s in sections)
    x = np.random.default_rng(1).normal(size=(2, 200))
    y = x[0].copy()
    for b0, b1, b2, a1, a2 in sections:  # the difference equation itself
        out = np.zeros_like(y)
        for k in range(len(y)):
            out[k] = b0 * y[k] + (b1 * y[k - 1] - a1 * out[k - 1] if k > 0 else 0) + (b2 * y[k - 2] - a2 * out[k - 2] if k > 1 else 0)
        y = out
    assert np.allclose(filtered(x, sections)[0], y)


def test_spectra_are_the_direct_transform(spark):
    from temblor.operators.signals import power_in_band, spectra

    rng = np.random.default_rng(2)
    x = {s: np.sin(2 * np.pi * 0.01 * np.arange(n)) * 5 + rng.normal(size=n) for s, n in ((1, 3500), (2, 600), (3, 599))}
    df = spark.createDataFrame([(s, k, float(v)) for s, xs in x.items() for k, v in enumerate(xs)], "station long, k long, x double")
    got = {}
    for r in spectra(df, rate=1.0, butterworth=False, windows=4).collect():
        got.setdefault((r.station, r.w), {})[round(r.f * 600)] = r.power
    assert set(got) == {(1, w) for w in range(10)} | {(2, 0)}  # ten whole windows, one, none
    for (s, w), power in got.items():
        part = x[s][w * 300 : w * 300 + 600]
        part = (part - part.mean()) * np.hanning(600)
        for b in range(2, 13):
            direct = abs(sum(v * np.exp(-2j * np.pi * b * i / 600) for i, v in enumerate(part))) ** 2 / 600
            assert abs(power[b] - direct) <= 1e-9 * max(1, direct)
        assert max(power, key=power.get) == 6
    assert len(power_in_band(np.zeros((1, 600)), 1.0, 0.002, 0.02, True)[0]) == 11
