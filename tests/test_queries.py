"""Every query with SQL against that SQL; the others against plain Python or invariants."""

import math

import pytest
from conftest import SF
from pyspark.sql import functions as F

from temblor.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(name, spark, same_as_sql):
    same_as_sql(registry.QUERIES[name](spark, SF), registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["gk_lookback_counts", "twin_pairs", "escalation_label", "forecast_resolve"])
def test_no_large_nested_loop(name, spark):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(registry.QUERIES["hot_dim_having"](spark, SF))
    assert "GreaterThanOrEqual(l_shipdate" in plan and "l_tax" not in plan


def quakes_of(spark):
    from temblor.sources.projection import quakes

    return quakes(spark, SF).collect()


def haversine(a, b):
    p, q = math.radians(a.lat), math.radians(b.lat)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def test_neighbours_across_the_antimeridian(spark):
    from temblor.operators.nearby import neighbours

    df = spark.createDataFrame([(1, 0.0, 179.9, 0.0), (2, 0.0, -179.9, 5.0), (3, 89.5, 10.0, 0.0), (4, 89.5, -170.0, 1.0), (5, 40.0, 0.0, 0.0)], "event_id long, lat double, lon double, ep double")
    got = {(r.l.event_id, r.r.event_id) for r in neighbours(df, df, km=150, back=10, ahead=10).collect()}
    assert {(1, 2), (2, 1), (3, 4), (4, 3)} <= got and not {(1, 5), (5, 1)} & got


def test_neighbours_with_a_reach_of_each_row(spark):
    """Against all pairs, near the poles and the antimeridian too."""
    import random
    from types import SimpleNamespace

    from temblor.operators.nearby import neighbours

    r = random.Random(7)
    rows = [(i, r.choice((-89.5, -60.0, 0.0, 35.0, 84.0, 89.9)) + r.uniform(-0.5, 0.09), (r.choice((-180.0, 10.0, 179.5)) + r.uniform(0, 0.5) + 180) % 360 - 180, r.uniform(0, 40) * 86400.0, r.choice((0.0, 15.0, 40.0, 90.0, 300.0))) for i in range(220)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, ep double, km double")
    got = {(x.l.id, x.r.id) for x in neighbours(df, df, km=300, back=12 * 86400.0, ahead=3600.0, reach=F.col("km")).collect()}
    points = [SimpleNamespace(id=i, lat=a, lon=o, ep=e, km=k) for i, a, o, e, k in rows]
    assert got == {(a.id, b.id) for a in points for b in points if a.ep - 12 * 86400.0 <= b.ep <= a.ep + 3600.0 and (a is b or haversine(a, b) <= a.km)}


def test_trailing_sums(spark):
    """Against all pairs: blocks without events, equal seconds, null amounts, a null zone."""
    import random

    from temblor.operators.trailing import trailing_extrema, trailing_sums

    r = random.Random(11)
    rows = [(r.choice((0, 1, None)), i, r.choice((0, 86399, 86400, 5 * 86400, r.randrange(9 * 86400))), r.choice((None, 1, 5))) for i in range(150)]
    df = spark.createDataFrame(rows, "zone long, event_id long, t long, x long")
    got = {w.event_id: (w.n_86400, w.x_86400, w.x_300000) for w in trailing_sums(df, [86400, 300000], {"n": F.lit(1), "x": F.col("x")}).collect()}

    def near(z, t, w):
        return [x for y, _, u, x in rows if y == z and t - w <= u <= t]

    assert got == {i: (len(near(z, t, 86400)), sum(x or 0 for x in near(z, t, 86400)), sum(x or 0 for x in near(z, t, 300000))) for z, i, t, _ in rows}
    ends = {w.event_id: (w.low_86400, w.high_86400, w.low_300000) for w in trailing_extrema(df, [86400, 300000], "x").collect()}
    low, high = (lambda z, t, w, fn=fn: fn((x for x in near(z, t, w) if x is not None), default=None) for fn in (min, max))
    assert ends == {i: (low(z, t, 86400), high(z, t, 86400), low(z, t, 300000)) for z, i, t, _ in rows}
    assert trailing_sums(df.limit(0), [60], {"n": F.lit(1)}).count() == 0


def test_decluster_is_the_one_by_one_order(spark):
    q = sorted(quakes_of(spark), key=lambda r: (-r.magnitude, r.event_id))
    state = {}
    for e in q:
        if e.event_id in state:
            continue
        state[e.event_id] = True
        radius = 10 ** (0.1238 * e.magnitude + 0.983)
        days = 10 ** (0.032 * e.magnitude + 2.7389) if e.magnitude >= 6.5 else 10 ** (0.5409 * e.magnitude - 0.547)
        for o in q:
            if o.event_id not in state and o.magnitude < e.magnitude and abs(o.ep - e.ep) <= days * 86400 and haversine(e, o) <= radius:
                state[o.event_id] = False
    got = {r.event_id: r.main for r in registry.QUERIES["decluster"](spark, SF).collect()}
    assert got == state


def test_density_clusters(spark):
    from temblor.operators.cluster import density_clusters

    rows = [(i, 0.0, i * 0.1, float(i)) for i in range(6)] + [(50, 40.0, 0.0, 0.0), (51, 40.0, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "event_id long, lat double, lon double, ep double")
    got = {r.event_id: r.cluster for r in density_clusters(df, km=25, seconds=100, least=4).collect()}
    # 0 and 5 are borders of the chain; 50 and 51 are too few
    assert set(got) == set(range(6)) and len(set(got.values())) == 1


def test_alert_hysteresis():
    from temblor.streaming.live import judge

    hour = 3600.0
    times, mags = [0, hour, 2 * hour, 2.5 * hour, 3 * hour, 6 * hour, 7 * hour], [4.0, 4.5, 4.5, 3.0, 4.6, 3.0, 5.0]
    out, state = judge(times, mags, None)
    assert out == [(hour, 3), (3 * hour, 3), (7 * hour, 4)] and state == (4, 7 * hour)
    assert judge(times[:1], [5.0], None)[0] == []  # the first reading is the baseline
    # two parts with the state between them are as one
    a, s = judge(times[:3], mags[:3], None)
    b, _ = judge(times[3:], mags[3:], s)
    assert a + b == out


def test_stream_alerts_are_the_batch_alerts(spark):
    from temblor.streaming.live import judge

    zones = {}
    for r in sorted(quakes_of(spark), key=lambda r: (r.ep, r.event_id)):
        zones.setdefault(math.floor((r.lon + 180) / 30), []).append((r.ep, r.magnitude))
    want = {(z, t, x) for z, rows in zones.items() for t, x in judge([t for t, _ in rows], [m for _, m in rows], None)[0]}
    assert {tuple(r) for r in registry.QUERIES["stream_alerts"](spark, SF).collect()} == want


def test_feeds(spark):
    from temblor.sources import feeds

    text = lambda s: spark.createDataFrame([(s, "st1")], "text string, station string")
    pipe = "#head\n1|2024-01-01T00:00:00|10|20|5|a|b|c|d|ml|4.5|x|place\nshort|row\n2|2024-01-01T00:00:00|bad|20|5|a|b|c|d|ml|4.5|x|p\n"
    assert [(r.id, r.magnitude) for r in feeds.pipe_catalog(text(pipe)).collect()] == [("emsc:1", 4.5)]
    wind = '[["time_tag","density","speed"],["2024-01-01 00:00:00","5.5",null],["2024-01-01 00:01:00","6","400"]]'
    assert sorted((r.metric, r.value) for r in feeds.header_array(text(wind)).collect()) == [("density", 5.5), ("density", 6.0), ("speed", 400.0)]
    kp = "2024 01 01 10 20 -1 30 40 50 60 70\n"
    assert [r.value for r in feeds.three_hour_kp(text(kp)).orderBy("time").collect()] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    buoy = "#YY MM\n24 01 02 03 04 05 1 4000.5\n99 01 02 03 04 05 3 9999\n"
    assert [(r.station, r.time.year, r.height) for r in feeds.buoy_heights(text(buoy)).collect()] == [("st1", 2024, 4000.5)]
    flares = '[{"beginTime":"2024-01-01T00:00:00Z","classType":"M2.5"},{"beginTime":"2024-01-01T00:00:00Z","classType":"?"}]'
    assert sorted(r.value for r in feeds.flares(text(flares)).collect()) == [1.0, 4.25]
    agency = '{"features":[{"id":"a","properties":{"mag":4.1,"time":"2024-01-01T00:00:01.5Z","unid":"b"},"geometry":{"coordinates":[1,2]}},{"id":"c","properties":{"mag":4.1,"time":"soon"}},{"id":"d","properties":{"time":"2024-01-01T00:00:00Z"}}]}'
    assert [(r.id, r.ep % 60, r.lon, r.depth_km, r.place) for r in feeds.agency_quakes(text(agency)).collect()] == [("emsc_b", 1.5, 1.0, None, "")]
    tags = '[{"time_tag":"2024-01-01T00:01:00","kp":3,"dst":null},{"time_tag":"2024-01-01T02:00:00+02:00","kp":"2.33"},{"time_tag":"","kp":1},{"kp":1}]'
    assert sorted((r.metric, r.value, r.time.minute) for r in feeds.tagged(text(tags), {"kp": "k", "dst": "d"}).collect()) == [("k", 2.33, 0), ("k", 3.0, 1)]
    flat = '{"features":[{"id":"a","properties":{"mag":4.1,"time":1500},"geometry":{"coordinates":[1,2]}},{"id":"b","properties":{"mag":4.2,"time":2000}}]}'
    assert sorted((r.id, r.ep, r.lat, r.depth_km) for r in feeds.geojson_quakes(text(flat)).collect()) == [("a", 1.5, 2.0, None), ("b", 2.0, None, None)]
    assert feeds.header_array(text("[]")).count() == 0 and feeds.header_array(text('[["time_tag","x"],[]]')).count() == 0
    assert feeds.tagged(text("not json"), {"kp": "k"}).count() == 0 and feeds.agency_quakes(text("")).count() == 0
    omni = "2024 32 5 3.5 400 37\n2024 32 6 999.9 9999 99\n"
    got = {r.metric: (r.time.month, r.time.hour, r.value) for r in feeds.hourly_wind(text(omni)).collect()}
    assert got == {"bz": (2, 5, 3.5), "speed": (2, 5, 400.0), "kp": (2, 5, 3.7)}


def test_sinks(spark, tmp_path):
    from temblor.sources import sinks

    a = spark.createDataFrame([(1, None), (1, None), (2, 3)], "k int, v int")
    b = spark.createDataFrame([(2, 3)], "k int, v int")
    assert [tuple(r) for r in sinks.only_new(a, b, ["k", "v"]).collect()] == [(1, None)]
    df = spark.createDataFrame([(0.0,), (1e9,)], "ep double")
    sinks.by_year(df, str(tmp_path / "y"))
    assert {r.year for r in spark.read.parquet(str(tmp_path / "y")).collect()} == {1970, 2001}
    lines = sinks.one_line_an_hour(spark.createDataFrame([(10.0, 1), (20.0, 2), (4000.0, 3)], "ep double, x int"), spark.createDataFrame([(1,)], "hour long"))
    assert [(r.hour, r.line) for r in lines.collect()] == [(0, '{"ep":20.0,"x":2}')]


def test_counts_grow_with_the_window(spark):
    bad = registry.QUERIES["gk_lookback_counts"](spark, SF).where("not (n_24h <= n_72h and n_72h <= n_7d and n_7d <= n_30d)")
    assert bad.count() == 0


def test_model_bands(spark):
    r = registry.QUERIES["event_model"](spark, SF).agg(F.sum("n").alias("n")).first()
    assert r.n > 0


def test_swarm_query(spark):
    assert registry.QUERIES["swarm_clusters"](spark, SF).where("n < 1").count() == 0


def test_forecasts_of_every_id_have_a_chain(spark):
    got = {r.fid % 10 for r in registry.QUERIES["probability_chain"](spark, SF).select("fid").distinct().collect()}
    assert got == set(range(10))


@pytest.mark.parametrize("mags, taps, longest", [([3.0, 3.2, 4.1], 1, 3), ([3.0, 3.4, 4.1], 0, 3), ([3.0, 2.9, 2.8], 0, 1), ([3.0, 3.3, 4.0], 1, 3), ([3.0], 0, None)])
def test_double_taps_and_runs(spark, mags, taps, longest):
    from temblor.plans.sequences import sequence_features

    rows = [(1, i, float(i), 86400.0, m) for i, m in enumerate(mags)]
    got = sequence_features(spark.createDataFrame(rows, "event_id long, other long, other_ep double, dt double, m double")).first()
    assert (got.double_taps, got.longest) == (taps, longest) and (got.trend is None) == (len(mags) < 3)


def test_ladder(spark):
    from temblor.plans.sequences import LADDER

    rows = [(0, 0.0, 0, 0, 0.0), (5, 1.5, 1, 3, 0.2), (4, 1.5, 1, 3, 0.2), (4, 1.2, 0, 3, 0.2), (3, 1.2, 0, 2, 0.2), (3, 1.2, 0, 2, 0.1), (2, 1.2, 0, 2, 0.2)]
    got = spark.createDataFrame(rows, "n_7d long, rumble double, double_taps long, longest long, trend double").select(F.expr(LADDER)).collect()
    assert [r[0] for r in got] == ["isolated", "rumble", "double_tap", "staircase", "accelerating", "active_sequence", "early_sequence"]


def test_chain_is_monotone(spark):
    from temblor.plans.features import chains

    rates = spark.createDataFrame([(4.0, 4.5, 0.2), (4.0, 5.0, 0.3), (4.0, 5.5, 0.001), (4.0, 4.0, 0.9)], "bin double, threshold double, rate double")
    got = chains(spark.createDataFrame([(1, 0.5, 4.2)], "fid long, p double, seq_max double"), rates).orderBy("threshold").collect()
    assert [tuple(r) for r in got] == [(1, 4.5, 0.1), (1, 5.0, 0.1)]


def test_greedy_clusters_is_the_one_by_one_order(spark):
    from temblor.operators.cluster import greedy_clusters

    q = sorted(quakes_of(spark), key=lambda r: (-(r.event_id * 37 % 10), r.event_id))
    want = {}
    for a in q:
        if a.event_id not in want:
            for b in q:
                if b.event_id not in want and abs(a.ep - b.ep) <= 5 * 86400 and haversine(a, b) <= 400:
                    want[b.event_id] = a.event_id
    rows = spark.createDataFrame([(r.event_id, r.ep, r.lat, r.lon, float(r.event_id * 37 % 10)) for r in q], "event_id long, ep double, lat double, lon double, p double")
    got = {r.event_id: r.cluster for r in greedy_clusters(rows, km=400.0, seconds=5 * 86400.0).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_velocity_of_the_first_and_of_ties(spark):
    """The first forecast of each zone is new."""
    from temblor.plans.analytics import forecasts

    first = {}
    for r in sorted(forecasts(spark, SF).collect(), key=lambda r: (r.issued, r.fid)):
        first.setdefault(r.zone, r.fid)
    got = {r.fid: r.direction for r in registry.QUERIES["watch_velocity"](spark, SF).collect()}
    assert set(got.values()) >= {"NEW", "RISING", "FALLING"} and all(got[f] == "NEW" for f in first.values())
