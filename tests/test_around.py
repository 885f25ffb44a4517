import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

DAY = 86400.0


@pytest.mark.parametrize("back, ahead", [(12 * DAY, 0.0), (0.0, 5 * DAY)])
def test_around_finds_what_pairs_find(spark, back, ahead):
    """Poles, the antimeridian, places that repeat, and circles of both classes."""
    from temblor.operators.around import across, around
    from temblor.operators.nearby import neighbours

    def count_and_top(near, own, lo, hi):
        return {"event_id": own["event_id"], "n": hi - lo, "top": across(np.fmax, near["magnitude"], lo, hi), "apart": across(np.maximum, near["apart"], lo, hi)}

    r = np.random.default_rng(3)
    n = 500
    lat = np.where(r.random(n) < 0.3, r.uniform(88, 90, n), np.round(r.uniform(-2, 2, n), 1))
    lon = np.where(r.random(n) < 0.5, (r.uniform(179, 181, n) + 180) % 360 - 180, np.round(r.uniform(-1, 1, n), 1))
    rows = [(i, float(r.integers(0, 30 * 24) * 3600), float(a), float(o), float(r.integers(25, 60) / 10), float(r.choice([5.0, 30.0, 40.0, 41.0, 300.0]))) for i, (a, o) in enumerate(zip(lat, lon, strict=True))]
    df = spark.createDataFrame(rows, "event_id long, ep double, lat double, lon double, magnitude double, km double").cache()
    schema = {"event_id": pa.int64(), "n": pa.int64(), "top": pa.float64(), "apart": pa.float64()}
    got = {x.event_id: (x.n, x.top, round(x.apart, 6)) for x in around(df, df.drop("km"), 300.0, count_and_top, schema, back=back, ahead=ahead, reach=F.col("km"), chosen=("ep", "magnitude")).collect()}
    pairs = neighbours(df, df, km=300.0, back=back, ahead=ahead, reach=F.col("km")).where("r.ep < l.ep" if back else "r.ep > l.ep")
    want = {x.id: (x.n, x.top, round(x.apart, 6)) for x in pairs.groupBy(F.col("l.event_id").alias("id")).agg(F.count("*").alias("n"), F.max("r.magnitude").alias("top"), F.max("km").alias("apart")).collect()}
    assert got == want and len(got) > 100


def test_folds_over_ranges():
    from temblor.operators.around import across, first_most, longest_rises, longest_runs, medians, slopes

    v = np.array([3.0, 3.2, 2.0, 2.5, 2.5, 1.0])
    lo, hi = np.array([0, 0, 2, 6]), np.array([6, 2, 5, 6])
    falls = np.flatnonzero(np.diff(v) < 0) + 1
    assert across(np.maximum, v, lo, hi, -1).tolist() == [3.2, 3.2, 2.5, -1]
    assert medians(v, lo, hi)[:3].tolist() == [2.5, 3.1, 2.5] and np.isnan(medians(v, lo, hi)[3])
    assert longest_runs(falls, lo, hi).tolist() == [3, 2, 3, 0]
    assert longest_rises(falls, lo[:3], hi[:3], np.array([False, True, True])).tolist() == [2, 1, 2]
    assert first_most(v, lo, hi).tolist() == [1, 1, 1, -1]
    assert np.allclose(slopes(v, lo, hi)[[0, 2]], [np.polyfit(range(6), v, 1)[0], 0.25]) and np.isnan(slopes(v, lo, hi)[1])


@pytest.mark.parametrize("back, ahead, least", [(12 * DAY, 0.0, 4), (0.0, 5 * DAY, 4), (3 * DAY, 3 * DAY, 8), (0.0, 5 * DAY, 128)])
def test_strongest_near_finds_what_going_through_finds(back, ahead, least, monkeypatch):
    """Blocks of every number, windows within one block and over many, magnitudes that are not known, events without neighbours."""
    from temblor.operators import around

    monkeypatch.setattr(around, "LEAST", least)
    monkeypatch.setattr(around, "AT_ONCE", 500)
    monkeypatch.setattr(around, "STRONGEST", 64 if least == 128 else 3)
    r, n = np.random.default_rng(9), 700
    rows = {"event_id": np.arange(n), "ep": np.round(r.uniform(0, 30, n)) * DAY / 2, "lat": r.integers(0, 6, n) / 10.0, "lon": r.integers(0, 6, n) / 10.0 + (r.random(n) < 0.02) * 5, "magnitude": np.where(r.random(n) < 0.3, np.nan, r.integers(25, 60, n) / 10), "reach": r.choice([5.0, 20.0, 60.0], n)}
    out = pa.schema([("event_id", pa.int64()), ("m", pa.float64()), ("n", pa.int64())])
    got = {x["event_id"]: (x["m"], x["n"]) for x in around._tally(pa.table(rows), pa.table(rows), out, back, ahead, around.arc_km).to_pylist()}
    want = {}
    for i in range(n):
        near = around.arc_km(rows["lat"][i], rows["lon"][i], rows["lat"], rows["lon"]) <= rows["reach"][i]
        near &= ((rows["ep"] >= rows["ep"][i] - back) if back else (rows["ep"] > rows["ep"][i])) & ((rows["ep"] <= rows["ep"][i] + ahead) if ahead else (rows["ep"] < rows["ep"][i]))
        m = rows["magnitude"][near]
        if near.any():
            want[i] = (None if np.isnan(m).all() else np.nanmax(m), near.sum())
    assert got == want and 500 < len(got) <= n


def test_a_row_goes_to_few_cells(spark):
    """Rows all over a band, for circles of one class and windows of a week: fewer than three copies of each."""
    from temblor.operators.around import _surroundings

    rows = spark.range(5000).selectExpr("id AS event_id", "id * 700.0D AS ep", "-20 + (id * 7919) % 4001 / 100.0D AS lat", "-180 + (id * 104729) % 36000 / 100.0D AS lon")
    a, b = _surroundings(rows, rows, 100.0, 0.0, 7 * DAY, F.lit(100.0), False, rows.columns)
    assert a.count() == 5000 and b.count() < 3 * 5000


def test_strongest_near_does_not_go_through_a_dense_place():
    """20,000 events at 400 places, all with circles of their own, within a week: two hundred million neighbours take far longer."""
    import time

    from temblor.operators import around

    r, n = np.random.default_rng(2), 20_000
    rows = pa.table({"event_id": np.arange(n), "ep": r.uniform(0, 7 * DAY, n), "lat": r.integers(0, 20, n) / 100.0, "lon": r.integers(0, 20, n) / 100.0, "magnitude": r.integers(25, 60, n) / 10, "reach": r.uniform(10, 40, n)})
    start = time.perf_counter()
    found = around._tally(rows, rows, pa.schema([("event_id", pa.int64()), ("m", pa.float64()), ("n", pa.int64())]), 0.0, 7 * DAY, around.arc_km)
    took = time.perf_counter() - start
    strongest = lambda near, own, lo, hi: {"event_id": own["event_id"], "m": around.across(np.fmax, near["magnitude"], lo, hi), "n": hi - lo}
    start = time.perf_counter()
    old = around._judge(rows, rows, ["event_id", "ep", "lat", "lon"], ["event_id", "ep", "lat", "lon", "magnitude"], found.schema, 0.0, 7 * DAY, around.arc_km, strongest, ("ep", "magnitude"), True, None)
    assert found.sort_by("event_id") == old.sort_by("event_id") and 2 * took < time.perf_counter() - start


@pytest.mark.parametrize("name", ["gk_lookback_counts", "sequence_energy", "sequence_shapes", "sequence_matrix", "regional_features", "peak_depth", "trajectory_shapes", "pattern_signatures", "radius_window_sweep", "escalation_label", "forward_label"])
def test_pairs_of_a_dense_place_are_not_rows(spark, tmp_path, name):
    """All events of a place, 1,500 in two days, are near each other: a million pairs, of which none is shuffled."""
    from temblor.plans import registry

    spark.range(1500).selectExpr("id * 1000 AS event_id", "timestamp_seconds(1704067200 + id * 100) AS ts", "7L AS user_id", "'view' AS event_type", "double(id % 90) AS value", "string(null) AS props").write.parquet(f"{tmp_path}/events.parquet")
    out = registry.QUERIES[name](spark, str(tmp_path))
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapCoGroups" in plan and "bucket" not in "".join(line for line in plan.splitlines() if "SortMergeJoin" in line)
    if name == "gk_lookback_counts":
        assert sorted((r.event_id // 1000, r.n_30d, r.n_24h) for r in rows) == [(i, i, min(i, 864)) for i in range(1, 1500)]


def test_extrema_ahead(spark):
    """Windows of several spans against all pairs; ends count, and starts on the edge of a block."""
    from temblor.operators.trailing import extrema_ahead

    r = np.random.default_rng(5)
    events = [(int(z), int(t), float(v)) for z, t, v in zip(r.integers(0, 3, 200), r.integers(-50, 400, 200), r.integers(0, 99, 200), strict=True)]
    points = [(i, i % 4, int(t), 10 * (1 + i % 3)) for i, t in enumerate(r.integers(-60, 400, 300))] + [(300, 0, 22, 10), (301, 1, 42, 20)]
    got = extrema_ahead(spark.createDataFrame(points, "id long, zone long, start long, span long"), spark.createDataFrame(events, "zone long, t long, v double"), ["zone"], "v")
    want = {}
    for i, zone, start, span in points:
        inside = [(t, v) for z, t, v in events if z == zone and start <= t <= start + span]
        if inside:
            want[i] = (max(v for _, v in inside), min(t for t, _ in inside))
    assert {x.id: (x.most, x["first"]) for x in got.collect()} == want


def test_forecasts_and_strong_events_are_not_paired(spark):
    from temblor.plans.analytics import resolved

    plan = resolved(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "day#" not in plan


def test_a_forecast_travels_once(spark, tmp_path):
    """No window over forecasts and no join back by their id; orders without a key stay, unresolved, and one row of top scores is ranked by its blocks."""
    from temblor.plans import analytics

    plan = analytics.resolved(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapCoGroups" in plan and "Window" not in plan and "SortMergeJoin" not in plan
    spark.range(400).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id * 6000) AS ts", "if(id % 9 = 0, null, id * 7) AS user_id", "'view' AS event_type", "double(id) AS value", "string(null) AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3000).selectExpr("if(id % 500 = 0, null, id) AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    rows = analytics.forecast_resolve(spark, str(tmp_path)).collect()
    assert len(rows) == 3000 and sum(r.fid is None for r in rows) == 6 and {r.outcome for r in rows if r.fid is None} == {"false_alarm"}
    assert {r.outcome for r in rows} == {"hit", "false_alarm"} and all((r.actual is None) == (r.outcome == "false_alarm") for r in rows)


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_equal_scores_are_ranked_in_blocks(spark, monkeypatch, same_as_sql, block):
    from temblor.plans import analytics, registry

    monkeypatch.setattr(analytics, "EDGE_BLOCK", block)
    same_as_sql(analytics.precision_at_k(spark, "/root/testdata/sf0.001"), registry.ORACLES["precision_at_k"])


def test_only_top_forecasts_are_resolved(spark, monkeypatch):
    from temblor.plans import analytics

    resolved, asked = analytics.resolved, []
    monkeypatch.setattr(analytics, "resolved", lambda spark, sf_dir, of=None: asked.append(of) or resolved(spark, sf_dir, of))
    analytics.precision_at_k(spark, "/root/testdata/sf0.001").collect()
    assert [of.count() < 0.2 * analytics.forecasts(spark, "/root/testdata/sf0.001").count() for of in asked] == [True]


def test_score_quality_resolves_once(spark, monkeypatch):
    from temblor.plans import evidence

    resolved, seen = evidence.resolved, spark.sparkContext.accumulator(0)
    mark = F.udf(lambda z: seen.add(1) or z, "long").asNondeterministic()
    monkeypatch.setattr(evidence, "resolved", lambda spark, sf_dir: resolved(spark, sf_dir).withColumn("zone", mark("zone")))
    n = evidence.score_quality(spark, "/root/testdata/sf0.001").where("zone is null").collect()[0].n
    assert seen.value == n


@pytest.mark.parametrize("name, n", [("nearest_station", 40), ("station_graph", 40)])
def test_stations_of_one_place(spark, tmp_path, name, n):
    """Many stations at few places: the first of a place is the nearest; all are in the graph."""
    from temblor.plans import registry

    spark.range(n).selectExpr("id * 1000 AS event_id", "timestamp_seconds(1704067200 + id * 100) AS ts", "id % 3 AS user_id", "'view' AS event_type", "double(id % 90) AS value", "string(null) AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(n).selectExpr("id % 2 + 360 * (id div 2) AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "nearest_station":
        assert len(rows) == n and {r.station for r in rows} <= {0, 1}
    else:
        assert {(r.src, r.dst) for r in rows if r.src % 360 == r.dst % 360} == {(a + 360 * i, a + 360 * j) for a in (0, 1) for i in range(20) for j in range(20) if i != j}


def test_trails_and_twins_do_not_scan_what_is_kept():
    """A busy zone: 60,000 points in two days, and a cell whose 40,000 rows are looked through by few; scanning takes minutes."""
    import time

    from temblor.streaming.watch import BACK, KEEP, TWIN_S, trail_fold, twin_fold

    start = time.perf_counter()
    rows = [(3 * i, i, (i % 97) / 100) for i in range(60_000)]
    out, trail, _ = trail_fold(rows, [], 0)
    assert [o[1] for o in out[:2]] == [None, 0.0] and out[59_999][1] == rows[59_999 - BACK // 3][2]
    assert trail[0][0] == rows[-1][0] - KEEP and len(trail) == KEEP // 3 + 1
    rows = [(float(i), i, int(i % 100 == 0), 0, 3.0, 0.0, 0.0) for i in range(100_000)]
    out, past, _ = twin_fold(rows, [(0.0, -1, 0, 1, 3.0, 0.0, 0.0)], 0)
    assert out[0] == (0, 0, -1) and out[TWIN_S // 100 + 1] == (TWIN_S + 100, 1, None) and len(past) == TWIN_S + 1
    assert time.perf_counter() - start < 60


def test_volcanoes_of_one_place(spark):
    from temblor.sources.reports import attributed

    spots = spark.createDataFrame([(0.0, 0.1)], "lat double, lon double")
    plan = attributed(spots, spark.range(5).selectExpr("id + 7 AS volcano", "0D AS lat", "0D AS lon"))
    assert [(r.volcano, r.km) for r in plan.collect()] == [(7, 11.1)]


def test_trees_are_no_longer_than_their_rows(spark):
    """1,000 events of one place are linked by 999 pairs in each group, not by half a million."""
    from temblor.operators.around import linking_trees

    df = spark.range(1000).selectExpr("id AS event_id", "double(id) AS ep", "1D AS lat", "1D AS lon")
    assert {r.b for r in linking_trees(df, 10.0, 1e4).collect()} >= set(range(1, 1000)) and linking_trees(df, 10.0, 1e4).count() < 2500


def test_claims_of_a_dense_place_are_not_written(spark, tmp_path, monkeypatch):
    """1,500 events of one place: a million claims, of which none is a row; what is kept of each round is a row an event."""
    from temblor.operators import cluster
    from temblor.plans import registry

    spark.range(1500).selectExpr("id * 1000 AS event_id", "timestamp_seconds(1704067200 + id * 100) AS ts", "7L AS user_id", "'view' AS event_type", "double(id % 90) AS value", "string(null) AS props").write.parquet(f"{tmp_path}/events.parquet")
    kept, keep = [], cluster.checkpointed
    monkeypatch.setattr(cluster, "checkpointed", lambda df: kept.append(keep(df)) or kept[-1])
    got = {r.event_id // 1000: r.main for r in registry.QUERIES["decluster"](spark, str(tmp_path)).collect()}
    assert sum(k.count() for k in kept) < 3000
    # Of value 80.5 and more the magnitude is greatest; all others are within its reach.
    assert got == {i: i % 90 >= 81 for i in range(1500)}


@pytest.mark.parametrize("height, length", [(1.5, 30 * DAY), (0.05, 0.7 * DAY)])
def test_strongest_first_is_the_one_by_one_order(spark, monkeypatch, height, length):
    """Chains over cells and slices, poles, the antimeridian, equal strengths, turns and nulls."""
    from temblor.operators import cluster
    from temblor.operators.around import arc_km

    monkeypatch.setattr(cluster, "HEIGHT", height)
    monkeypatch.setattr(cluster, "SLICE", length)
    r = np.random.default_rng(11)
    n = 300
    lat = np.where(r.random(n) < 0.3, r.uniform(88, 90, n), np.round(r.uniform(-0.5, 0.5, n), 1))
    lon = np.where(r.random(n) < 0.5, (r.uniform(179.5, 180.5, n) + 180) % 360 - 180, np.round(r.uniform(-0.5, 0.5, n), 1))
    rows = [(i, float(r.integers(0, 200)) * 3600, float(a), float(o), float(r.integers(0, 40)), int(r.integers(0, 2)), float(r.choice([5.0, 12.0, 20.0])), float(r.choice([0.5, 1, 2])) * DAY) for i, (a, o) in enumerate(zip(lat, lon, strict=True))]
    want = {i: True for i in range(n + 1)}
    for a in sorted(rows, key=lambda x: (-x[4], x[5])):
        for b in rows if want[a[0]] else ():
            if (-b[4], b[5]) > (-a[4], a[5]) and abs(a[1] - b[1]) <= a[7] and arc_km(a[2], a[3], b[2], b[3]) <= a[6]:
                want[b[0]] = False
    df = spark.createDataFrame([*rows, (n, 0.0, None, 0.0, 99.0, 0, 20.0, DAY)], cluster.ROW)
    assert {x.event_id: x.main for x in cluster.strongest_first(df).collect()} == want and 30 < sum(want.values()) < n - 30


def test_event_analysis_of_a_dense_place(spark, tmp_path):
    """600 strong and weak events of two places, several of one second: as the SQL says, and no pair is a row."""
    import duckdb

    from temblor.plans import registry

    spark.range(600).selectExpr("id * 1000 AS event_id", "timestamp_seconds(1704067200 + (id div 3) * 400) AS ts", "7L + 360 * (id % 5) + 13 * (id % 2) AS user_id", "'view' AS event_type", "double(id * 7919 % 560) AS value", "string(null) AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = registry.QUERIES["event_analysis"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapCoGroups" in plan and "bucket" not in "".join(line for line in plan.splitlines() if "SortMergeJoin" in line)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cursor = con.execute(registry.ORACLES["event_analysis"])
    want = {r[0]: r for r in cursor.fetchall()}
    names = [d[0] for d in cursor.description]
    got = {r.event_id: tuple(r[n] for n in names) for r in out.collect()}
    # The bearing of halves that have one centre is noise of the last digit.
    at = names.index("migration_bearing")
    assert {k: r[:at] + r[at + 1 :] for k, r in got.items()} == {k: r[:at] + r[at + 1 :] for k, r in want.items()} and len(got) > 300


@pytest.mark.parametrize("name", ["regional_matrix", "pattern_class", "pattern_signatures", "pattern_top20", "radius_window_sweep", "sequence_matrix", "peak_depth", "regional_features", "forward_label", "escalation_label", "sequence_energy", "trajectory_shapes", "gk_lookback_counts"])
def test_dense_places_as_the_sql_says(spark, tmp_path, name):
    """3,000 events at a thousand places within 22 km and some 100 km off, a third of them alike in all but their id: ranges overlap, circles are equal."""
    import duckdb
    from conftest import rows_of

    from temblor.plans import registry

    spark.range(3000).selectExpr("id % 1000 + 100000 * (id div 1000) AS event_id", "timestamp_seconds(1704067200 + (id % 1000) * 1300 + (id div 2000) * 77) AS ts", "7L + 360 * (id div 1000) + 13 * CAST(id % 11 = 0 AS INT) AS user_id", "'view' AS event_type", "double(id % 1000 * 7919 % 430) AS value", "string(null) AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cursor = con.execute(registry.ORACLES[name])
    # Ratios of energies go up to 1e12: as many digits as sums have.
    digits = lambda rows: [tuple(float(f"{v:.12g}") if isinstance(v, float) else v for v in r) for r in rows]
    want = rows_of([d[0] for d in cursor.description], digits(cursor.fetchall()))
    out = registry.QUERIES[name](spark, str(tmp_path))
    assert rows_of(out.columns, digits(map(tuple, out.collect()))) == want and want[1]


@pytest.mark.parametrize("together, times", [(True, 2), (False, 400)])
def test_circles_of_the_same_places_are_folded_once(together, times):
    """400 places of one region, 20 more far off; each event ten times: two sets of neighbours, and an event counts once for all that are alike."""
    from temblor.operators.around import _judge, arc_km

    k = np.arange(4200)
    place = k % 420
    far = place >= 400
    t = pa.table({"event_id": k, "ep": (place * 10).astype(float), "lat": place / 1e5 + 5.0 * far, "lon": np.where(far, 9.0, place / 1e5), "magnitude": 3 + place % 7 / 10, "reach": np.full(4200, 50.0)})
    seen = []

    def fold(near, own, lo, hi):
        seen.append(len(lo))
        return {"event_id": own["event_id"], "n": hi - lo}

    schema = pa.schema([("event_id", pa.int64()), ("n", pa.int64())])
    columns = ["event_id", "ep", "lat", "lon", "magnitude"]
    got = _judge(t, t, columns, columns, schema, 1e9, 0.0, arc_km, fold, ("ep",), together, None).to_pydict()
    assert dict(zip(got["event_id"], got["n"], strict=True)) == {int(i): int(10 * (p - 400 if p >= 400 else p)) for i, p in zip(k, place, strict=True) if p not in (0, 400)}
    assert len(seen) <= 2 and sum(seen) == 418 if together else len(seen) > times


def test_ranges_that_overlap_cost_as_the_values():
    """100,000 ranges of half of 100,000 values each: one by one they are five thousand million."""
    import time

    from temblor.operators.around import across, first_most, medians, slopes

    r = np.random.default_rng(1)
    start = time.perf_counter()
    v = 2.5 + r.integers(0, 40, 100_000) / 10
    lo = np.sort(r.integers(0, 50_000, 100_000))
    hi = lo + 50_000 - r.integers(0, 3, 100_000)
    got = [medians(v, lo, hi), first_most(v, lo, hi), across(np.add, v, lo, hi), across(np.minimum, v, lo, hi), slopes(v, lo, hi)]
    assert time.perf_counter() - start < 15
    for i in range(0, 100_000, 9_999):
        w = v[lo[i] : hi[i]]
        want = np.median(w), np.argmax(w), w.sum(), w.min(), np.polyfit(range(len(w)), w, 1)[0]
        assert np.allclose([float(g[i]) for g in got], want)
    short = np.array([5, 60, 7, 64, 9]), np.array([5, 130, 70, 128, 70])
    many = tuple(np.tile(x, 30_000) for x in short)
    for f, none in ((lambda a, b: across(np.maximum, v[:200], a, b), np.nan), (lambda a, b: first_most(v[:200], a, b), -1), (lambda a, b: medians(v[:200], a, b, 60), np.nan)):
        assert np.array_equal(f(*many)[:5], f(*short).astype(float), equal_nan=True) and np.array_equal(f(*many)[:1], [none], equal_nan=True)


@pytest.mark.parametrize("least", [4, 128])
def test_tallies_are_those_of_plain_loops(least, monkeypatch):
    """Windows within one block and over many, latest neighbours near by and far back, magnitudes that are not known, events alike and without neighbours."""
    from temblor.operators import around

    monkeypatch.setattr(around, "LEAST", least)
    monkeypatch.setattr(around, "AT_ONCE", 500)
    monkeypatch.setattr(around, "STRONGEST", 3)
    monkeypatch.setattr(around, "LATEST", 3)
    r, n = np.random.default_rng(5), 700
    rows = {"event_id": np.arange(n), "ep": np.round(r.uniform(0, 60, n)) * DAY / 2, "lat": r.integers(0, 6, n) / 10.0, "lon": r.integers(0, 6, n) / 10.0 + (r.random(n) < 0.02) * 5, "magnitude": np.where(r.random(n) < 0.3, np.nan, r.integers(25, 60, n) / 10), "reach": r.choice([5.0, 20.0, 60.0], n)}
    rows |= {c: np.where(np.arange(n) % 10 == 9, np.roll(rows[c], 1), rows[c]) for c in ("ep", "lat", "lon", "magnitude", "reach")}
    schema = pa.schema([("event_id", pa.int64()), ("magnitude", pa.float64()), *((f"n{k}", pa.int64()) for k in range(3)), *((c, pa.float64()) for c in ("top", "mean", "since", "after"))])
    asks, backs, ahead = pa.table(rows), (DAY, 7 * DAY, 20 * DAY), 3 * DAY
    own = ["event_id", "ep", "lat", "lon", "magnitude", "reach"]
    got = {x["event_id"]: x for x in around._tallies(asks, asks, schema, own, backs, ahead, around.arc_km).to_pylist()}
    known = lambda x: None if np.isnan(x) else x
    for i in range(n):
        near = around.arc_km(rows["lat"][i], rows["lon"][i], rows["lat"], rows["lon"]) <= rows["reach"][i]
        age = rows["ep"][i] - rows["ep"]
        before = [near & (age > 0) & (age <= b) for b in backs]
        m, later = rows["magnitude"][before[-1]], rows["magnitude"][near & (age < 0) & (age >= -ahead)]
        x = got[i]
        assert [x["n0"], x["n1"], x["n2"]] == [b.sum() for b in before] and x["magnitude"] == known(rows["magnitude"][i])
        assert x["top"] == (None if np.isnan(m).all() else np.nanmax(m)) and x["after"] == (None if np.isnan(later).all() else np.nanmax(later))
        assert x["since"] == (age[before[-1]].min() if len(m) else None) and (abs(x["mean"] - np.nansum(m) / len(m)) < 1e-9 if len(m) else x["mean"] is None)
    alone = around._tallies(asks, asks.slice(0, 0), schema, own, backs, ahead, around.arc_km).to_pylist()
    assert len(alone) == n == len(got) and all(x["n2"] == 0 and x["since"] is None for x in alone)


def test_event_model_makes_its_rows_once(spark, monkeypatch):
    """What the model is fitted on is a stored table, and both looks need one exchange of each side."""
    from pyspark.ml import Pipeline

    from temblor.operators import graph
    from temblor.plans import live

    fitted, made = [], []
    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, rows: fitted.append(rows) or fit(self, rows))
    monkeypatch.setattr(live, "checkpointed", lambda df: made.append(df) or graph.checkpointed(df), raising=False)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    live.event_model(spark, "/root/testdata/sf0.001").collect()
    assert "Exchange" not in plan(fitted[0]) and len(made) == 1 and plan(made[0]).count("REPARTITION_BY_NUM") == 2
