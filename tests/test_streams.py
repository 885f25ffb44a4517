"""The ledger of forecasts, scores on arrival and the cell-hour matrix, beside their SQL: orders of rows, failures, edges of windows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

HOUR = 3600


def test_judge():
    from temblor.streaming.ledger import EVENT, SCORE, judge

    score = lambda i, t, p, h=24: (SCORE, i, t, p, h, 5.0)
    event = lambda i, t, m=5.0: (EVENT, i, t, m, 0, 0.0)
    day = 24 * HOUR
    closed, left = judge([score(1, 0, 0.4), score(2, 10, 0.43), score(3, 20, 0.45)], [], 30)
    assert closed == [(1, 0, day, 0.4, 5.0, "superseded", 20, None, None)] and left == [(3, 20, 20 + day, 0.45, 5.0)]  # 0.43 is not a tenth more, 0.45 is
    assert judge([score(1, 0, 0.34)], [], 10) == ([], [])
    # an event at the very issue and at the very end is a hit; scores of one second come first
    assert judge([score(1, 50, 0.4), event(9, 50)], [], 50)[0] == [(1, 50, 50 + day, 0.4, 5.0, "hit", 50, 9, 5.0)]
    closed, left = judge([score(1, 0, 0.4), score(2, day, 0.35), event(9, day, 6.0)], [], day)
    assert [(c[0], c[5], c[7]) for c in closed] == [(1, "hit", 9), (2, "hit", 9)] and left == []
    # after a hit the zone is free; without one the end closes it, once time has passed it
    closed, left = judge([score(1, 0, 0.9), event(9, 100), score(2, 200, 0.4)], [], 300)
    assert [c[5] for c in closed] == ["hit"] and [f[0] for f in left] == [2]
    assert judge([], [(1, 0, 100, 0.5, 5.0)], 100)[0] == [] and judge([], [(1, 0, 100, 0.5, 5.0)], 101)[0][0][5:7] == ("false_alarm", 100)


def test_ledger_takes_rows_in_any_order(spark):
    """Within the delay, order, repeats and cuts into batches don't matter; what is later is left out."""
    from temblor.streaming import ledger
    from temblor.streaming.ordered import delivered

    r = random.Random(4)
    rows = [(0, i, i % 3, r.randrange(0, 200 * HOUR), round(r.uniform(0.3, 0.9), 2), r.choice((24, 48)), 5.0) for i in range(60)] + [(1, 100 + i, i % 3, r.randrange(0, 200 * HOUR), 5.5, 0, 0.0) for i in range(6)]
    end = [(0, 999, 9, 400 * HOUR, 0.5, 24, 5.0)]  # moves the watermark beyond all others
    late = [(1, 998, 0, 10 * HOUR, 9.0, 0, 0.0)]
    want = []
    for zone in range(3):
        mine = sorted({(k, i, t, x, h, g) for k, i, z, t, x, h, g in rows if z == zone}, key=lambda x: (x[2], x[0], x[1]))
        want += [(zone, *c) for c in ledger.judge(mine, [], 398 * HOUR)[0]]
    shuffled = rows + rows[::3]
    r.shuffle(shuffled)
    got = delivered(spark, [spark.createDataFrame(b, ledger.ROWS) for b in (shuffled + end, late + rows[:9])], ledger.ROWS, ledger.ledger, "test-ledger")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def scored(spark, batches, again=None):
    from temblor.operators.graph import shared_dir
    from temblor.plans.streams import score
    from temblor.streaming.scores import EVENTS, Scorer

    s = Scorer(shared_dir(spark, "test-scores"), score())
    for n, b in enumerate(batches):
        s(spark.createDataFrame(b, EVENTS), n)
        if n == again:
            s(spark.createDataFrame(b, EVENTS), n)  # a batch that failed after it wrote
    return sorted(map(tuple, s.table(spark).collect())), sorted(map(tuple, s.work(spark).collect()))


def test_scores_of_batches_are_those_of_one(spark):
    r = random.Random(12)
    place = lambda: (r.choice((0.0, 65.0)) + r.uniform(-1, 1), r.choice((179.5, 20.0)) + r.uniform(-1, 0.4))
    rows = [(i, r.uniform(0, 3) * 86400, *place(), r.choice((2.5, 3.5, 6.0))) for i in range(60)]
    one, _ = scored(spark, [rows])
    far = [(900, 3.01 * 86400, -40.0, 100.0, 4.0)]
    rest = rows[40:] + rows[:5]
    many, work = scored(spark, [rows[20:40], rows[:20] + rows[25:30], rest], again=1)
    assert many == one and len(one) > 20 and [w[1] for w in work] == [20, 20, 20]
    _, work = scored(spark, [rows, far])
    assert work[1][1:] == (1, 1, 1, 9)  # a far event touches its own cell and scores itself only


def test_cells_next_to_each_other():
    from temblor.streaming.scores import around

    assert set(around({9 * 36})) == {b * 36 + x for b in (8, 9, 10) for x in (35, 0, 1)}  # round the antimeridian
    assert set(around({17 * 36 + 5})) == {b * 36 + x for b in (16, 17) for x in range(36)}  # near a pole
    assert around(set()) == []


def events_on_the_hour(spark):
    r = random.Random(1)
    rows = [(z, i * 10 + z, float(r.choice((r.randrange(0, 1000 * HOUR), r.randrange(0, 1000) * HOUR))), r.choice((2.5, 3.0, 3.3, 4.0, 5.1)), r.choice((0.0, 10.0, 90.0))) for z in (0, 1) for i in range(150)]
    return rows, spark.createDataFrame(rows, "zone long, event_id long, ep double, magnitude double, depth_km double")


def test_cell_hours_with_events_on_the_hour(spark):
    from temblor.operators import cellhours

    rows, df = events_on_the_hour(spark)
    stress = df.withColumns({"lat": F.lit(1.0), "lon": F.lit(0.0)}).where("magnitude >= 5")
    centre = F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    got = {(x.zone, x.hour): x for x in cellhours.matrix(df, centre, stress).collect()}
    first, last = math.ceil(min(r[2] for r in rows) / HOUR), math.ceil(max(r[2] for r in rows) / HOUR)
    assert set(got) == {(z, h) for z in (0, 1) for h in range(first, last + 1)}
    for (zone, hour), x in got.items():
        past = [(hour * HOUR - r[2], r) for r in rows if r[0] == zone and r[2] <= hour * HOUR]
        within = lambda n: [r for age, r in past if age <= n * HOUR]  # noqa: E731, B023
        assert (x.eq_count_1h, x.eq_count_24h, x.eq_count_7d, x.eq_count_30d, x.m4_count_7d) == (len(within(1)), len(within(24)), len(within(168)), len(within(720)), sum(r[3] >= 4 for r in within(168)))
        week = [r[3] for r in within(168)]
        assert (x.max_mag_7d, x.max_mag_72h) == (max(week, default=0.0), max((r[3] for r in within(72)), default=0.0)) and abs(x.mag_range_7d - (max(week) - min(week) if week else 0)) < 1e-6
        assert abs(x.energy_24h - (math.log10(sum(10 ** (1.5 * r[3]) for r in within(24)) + 1) if within(24) else 0)) < 1e-5
        assert abs(x.time_since_last - (min(age for age, _ in past) / HOUR if past else 720)) < 1e-5
        assert abs(x.seq_active_ratio - (len(week) / len(within(720)) if week else 0)) < 1e-6
    assert cellhours.matrix(df.limit(0), centre, stress.limit(0)).count() == 0


def test_shape_of_a_sequence():
    from temblor.operators.cellhours import shape, trend

    r = random.Random(6)
    for _ in range(300):
        m = [r.choice((2.5, 2.8, 3.0, 3.1, 4.0, 4.1)) for _ in range(r.randint(1, 9))]
        longest = run = 1
        for a, b in zip(m, m[1:], strict=False):
            run = run + 1 if b >= a - 0.05 else 1
            longest = max(longest, run)
        taps = sum(abs(a - b) <= 0.3 + 1e-6 and c >= a + 1.0 - 1e-6 for a, b, c in zip(m, m[1:], m[2:], strict=False))
        want = (0, 0.0, 0, 0) if len(m) < 2 else (longest, max(m) / float(np.median(m)) if len(m) >= 3 else 0.0, taps, m.index(max(m)))
        assert shape(np.array(m)) == want
    assert trend(np.array([1.0, 2.0, 3.0])) == 1.0 and trend(np.array([1.0, 5.0])) == 0.0


def test_events_are_exchanged_once_for_the_sums(spark):
    """Sums by hour are made before the exchange, and all windows of a cell share one sort."""
    from temblor.operators import cellhours

    _, df = events_on_the_hour(spark)
    hours = cellhours.hour_sums(df, {"n": F.lit(1)})
    plan = cellhours.trailing(hours, {"n": [1, 6, 24]})._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and plan.count("Exchange hashpartitioning") == 2 and plan.count("Sort [") == 1


def test_folds_in_parts_are_those_of_the_whole():
    """What is kept carries all that a fold needs."""
    from temblor.streaming import watch
    from temblor.streaming.live import alert_fold

    r = random.Random(8)
    t = sorted(r.randrange(200_000) for _ in range(80))
    cases = [
        (watch.twin_fold, [(float(x), i, i % 2, i % 3, r.choice((3.0, 3.4)), r.uniform(0, 0.4), r.uniform(0, 0.4)) for i, x in enumerate(t)]), (watch.trail_fold, [(x, i, r.choice((0.1, 0.105, 0.5))) for i, x in enumerate(t)]),
        (watch.mode_fold, [(x, i, r.choice((1, 1, 2, 3))) for i, x in enumerate(t)]), (alert_fold, [(float(x), i, r.choice((3.0, 4.1, 4.6, 5.2))) for i, x in enumerate(t)]),
    ]
    for fold, rows in cases:
        whole, _, _ = fold(rows, [], 1e9)
        parts, kept = [], []
        for at in range(0, 80, 7):
            out, kept, _ = fold(rows[at : at + 7], kept, 1e9)
            parts += out
        assert parts == whole and whole
    assert any(not kept for _, kept, _ in watch.twin_fold(cases[0][1], [], 1e9)[0])
    assert watch.mode_fold([(0, 1, 1), (5, 2, 2), (6, 3, 2), (9, 4, 3)], [], 0)[0] == [(5, "EVENT", 0), (9, "TSUNAMI", 0)]
    assert [x[3] for x in watch.trail_fold([(0, 1, 0.5), (6 * HOUR, 2, 0.5), (12 * HOUR + 1, 3, 0.6), (60 * HOUR, 4, 0.1)], [], 0)[0]] == ["NEW", "STEADY", "RISING", "NEW"]


def test_twins_are_those_of_plain_loops():
    """The first report of another agency, also where the window holds many others, times are equal, and magnitudes or agencies are not known."""
    from temblor.streaming import watch

    r = random.Random(9)
    rows = sorted((float(r.randrange(0, 90_000, 20)), i, int(r.random() < 0.9), r.choice((0, 0, 0, 0, 0, 0, 0, 0, 1, 2, None)), r.choice((2.5, 3.0, 3.1, 4.6, 6.0, None)), r.uniform(9.6, 10.4), r.uniform(-0.6, 0.6)) for i in range(700))
    want = []
    for k, (t, i, own, agency, magnitude, lat, lon) in enumerate(rows):
        met = [p for p in rows[:k] if p[0] >= t - watch.TWIN_S and None not in (agency, magnitude, p[3], p[4]) and p[3] != agency and abs(p[4] - magnitude) <= 0.5 + 1e-9 and abs(p[5] - lat) <= 0.5 and abs(p[6] - lon) <= 0.5 and distance(lat, lon, p[5], p[6]) <= 50]
        if own:
            want.append((i, int(not met), met[0][1] if met else None))
    got, kept, _ = watch.twin_fold(rows, [], 1e9)
    assert got == want and 0 < sum(w[1] for w in want) < len(want) and kept == [p for p in rows if p[0] >= rows[-1][0] - watch.TWIN_S]


def distance(lat, lon, lats, lons):
    p, q = math.radians(lat), math.radians(lats)
    return 2 * 6371.0 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lons - lon) / 2) ** 2))


def test_reports_go_to_few_cells_and_packed(spark):
    """One row asks; less than half as many only answer; a task sends one row a key."""
    import pyarrow as pa

    from temblor.streaming import ordered, watch

    e = spark.range(2000).select(F.col("id").alias("event_id"), F.lit(5.0).alias("t"), F.lit(0).alias("agency"), F.lit(3.0).alias("magnitude"), (F.rand(1) * 120 - 60).alias("lat"), (F.rand(2) * 360 - 180).alias("lon"))
    posted = watch.posted(e)
    assert posted.where("own = 1").count() == 2000 and posted.count() < 1.5 * 2000
    edge = e.limit(1).withColumns({"lat": F.lit(5.2), "lon": F.lit(-180.0)})
    assert {(x.y, x.x, x.own) for x in watch.posted(edge).collect()} == {(1, -36, 1), (0, -36, 0), (1, -37, 0), (0, -37, 0)}
    schema = "t double, name string, n long"
    batches = [pa.RecordBatch.from_pylist([{"key": i % 2, "time": 1000 * i, "t": i / 1000, "name": None if i == 3 else "x", "n": (1 << 60) + i} for i in range(a, a + 5)], pa.schema([("key", pa.int64()), ("time", pa.timestamp("us", "UTC")), *ordered.arrow(schema)])) for a in (0, 5)]
    (out,) = ordered.packer("key", schema)(iter([batches[0].slice(0, 0), *batches]))
    assert out["key"].to_pylist() == [0, 1] and out["time"].cast(pa.int64()).to_pylist() == [8000, 9000]
    assert [ordered.tuples(ordered.unpacked([b], ordered.arrow(schema))) for b in out["rows"].to_pylist()] == [[(i / 1000, None if i == 3 else "x", (1 << 60) + i) for i in range(k, 10, 2)] for k in (0, 1)]


def test_scores_of_a_dense_place_are_no_pairs(spark, tmp_path):
    """Neighbours are not joined, and a batch writes a file for each cell."""
    from temblor.plans.streams import score
    from temblor.streaming.scores import Scorer, features

    e = spark.range(0, 400, 1, 4).select(F.col("id").alias("event_id"), (F.col("id") * 60.0).alias("ep"), (F.col("id") % 3 * 20.0).alias("lat"), F.lit(0.1).alias("lon"), F.lit(3.0).alias("magnitude"))
    assert "Join" not in features(e, e)._jdf.queryExecution().executedPlan().toString()
    scorer = Scorer(str(tmp_path), score())
    scorer(e, 0)
    got = {x.event_id: x for x in scorer.table(spark).collect()}
    assert len(got) == 400 and all((x.n_30d, x.hours_since) == (i // 3, 0.05 if i > 2 else 999.0) for i, x in got.items())
    assert sorted(len(list(c.glob("*.parquet"))) for c in (tmp_path / "catalogue" / "batch=0").glob("cell=*")) == [1, 1, 1]
