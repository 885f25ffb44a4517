"""The onset of storms and the boosts against plain loops."""

import pytest

from temblor.functions.sky import with_steps
from temblor.plans.threat import BOOSTS, onset


def plain_onset(by_sensor):
    mean = lambda x: sum(x) / len(x)
    found = [0.0]
    dst = by_sensor.get("dst", [])
    if (n := len(dst)) >= 4:
        q = max(1, n // 4)
        rate = (mean([v for _, v in dst[-q:]]) - mean([v for _, v in dst[:q]])) / max(0.5, (dst[-q][0] - dst[q - 1][0]) / 3600)
        if rate < -8:
            found.append(min(1, -rate / 25))
    orbit = [v for _, v in by_sensor.get("orbit", [])]
    if (n := len(orbit)) >= 6:
        third = max(2, n // 3)
        jump = mean(orbit[-third:]) - mean(orbit[: n - third])
        if jump > 10 or jump < -15:
            found.append(min(1, jump / 40 if jump > 0 else -jump / 50))
    ground = [v for _, v in by_sensor.get("ground", [])]
    if len(ground) >= 12:
        d = [abs(b - a) for a, b in zip(ground, ground[1:], strict=False)]
        third = max(2, len(d) // 3)
        if (old := mean(d[:-third])) > 0.01 and mean(d[-third:]) / old > 2:
            found.append(min(1, (mean(d[-third:]) / old - 1) / 4))
    return round(max(found), 3)


CASES = {
    "quiet": {"dst": [-5, -6, -5, -7, -6], "orbit": [100, 101, 99, 100, 102, 101, 100], "ground": [1, 2] * 7},
    "falls": {"dst": [-5, -8, -20, -31, -44, -57, -70, -82, -90]},
    "three readings": {"dst": [0, -50, -100]},
    "compression": {"orbit": [80, 81, 79, 82, 80, 95, 101, 99]},
    "expansion": {"orbit": [120, 118, 121, 119, 95, 88]},
    "ground": {"ground": [1, 2, 1, 2, 1, 2, 1, 2, 1, 4, 0, 5, 0, 4]},
    "eleven readings": {"ground": [1, 2, 1, 2, 1, 2, 1, 9, 0, 9, 0]},
    "steady ground": {"ground": [7] * 9 + [9, 7, 9, 7]},
    "all": {"dst": [0, -2, -30, -60], "orbit": [80, 80, 80, 80, 99, 99], "ground": [1, 2] * 6 + [9, 0, 9, 0, 9, 0]},
    "none": {},
}


@pytest.mark.parametrize("name", CASES)
def test_onset(name, spark):
    rows = {s: [(1000.0 + 900 * i, float(v)) for i, v in enumerate(x)] for s, x in CASES[name].items()}
    df = spark.createDataFrame([(s, ep, i, v) for s, x in rows.items() for i, (ep, v) in enumerate(x)], "sensor string, ep double, event_id long, v double")
    assert onset(df).first()["onset"] == pytest.approx(plain_onset(rows), abs=1e-9)


def test_boosts_work_in_turn(spark):
    rows = [(1, 0.3, 0.8, 0.5, 0.1, 0.06, 0.75), (2, 0.04, 0.9, 0.9, None, None, 0.9), (3, 0.3, 0.4, 0.1, None, 0.13, 0.5), (4, 0.97, 0.9, 0.9, 0.15, 0.13, 0.99), (5, 0.04, 0.9, 0.9, 0.06, None, None)]
    df = spark.createDataFrame(rows, "zone int, score double, stress double, onset double, buoy double, volcano double, p double")
    got = {r.zone: r for r in with_steps(df, BOOSTS).collect()}
    for zone, score, stress, storm, buoy, volcano, p in rows:
        s = score
        if stress > 0.4 and s > 0.05:
            s = round(min(1, s * (1 + 0.25 * stress)), 4)
        if storm > 0.1 and s > 0.05:
            s = round(min(1, s * (1 + 0.35 * storm)), 4)
        s = round(min(1, s + (buoy or 0)), 4)
        s = round(min(1, s + (volcano or 0)), 4)
        if (p or 0) > 0.5 and s > 0.05:
            s = round(min(1, s * (1 + 1.2 * (p - 0.5))), 4)
        assert got[zone].ml == pytest.approx(s, abs=1e-4), zone
    assert got[4].ml == 1 and got[2].tidal_boost == 0 and got[2].ml == pytest.approx(0.04) and got[5].ml == pytest.approx(0.1)
