"""Ranking, samples by hash, first-fit regions, the Moon, and awkward reports, against plain loops and known dates."""

import hashlib
import math
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F


def test_quality_of_scores(spark):
    from temblor.operators.ranking import quality, thresholds

    r = random.Random(2)
    rows = [(k, round(r.random(), 1 if k == "a" else 3), int(r.random() < 0.3)) for k in ("a", "b") for _ in range(150)] + [("c", 0.5, 1), ("c", 0.7, 1)]
    df = spark.createDataFrame(rows, "key string, score double, y int")
    got = {x.key: x for x in quality(thresholds(df, ["key"], "score", "y", F.floor(F.col("score") * 7)), ["key"]).collect()}
    assert (got["c"].auc, got["c"].ap, got["c"].n, got["c"].pos) == (None, None, 2, 2)
    for key in "ab":
        mine = [(s, y) for k, s, y in rows if k == key]
        good, bad = [s for s, y in mine if y], [s for s, y in mine if not y]
        assert abs(got[key].auc - sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))) < 1e-12
        ap = f1 = before = 0.0
        for t in sorted({s for s, _ in mine}, reverse=True):
            taken, hits = sum(s >= t for s, _ in mine), sum(y for s, y in mine if s >= t)
            ap += (hits / len(good) - before) * hits / taken
            before = hits / len(good)
            f1 = max(f1, 2 * hits / (taken + len(good)))
        assert abs(got[key].ap - ap) < 1e-12 and abs(got[key].f1 - f1) < 1e-12


def test_first_by_hash_is_exact(spark):
    from temblor.operators.ranking import first_by_hash, hash_order

    df = spark.range(3000).select((F.col("id") % 3).alias("key"), "id").withColumn("h", hash_order(F.lit("s"), F.col("id")))
    wanted = {0: 0, 1: 17, 2: 5000}
    got = first_by_hash(df, ["key"], "h", F.when(F.col("key") == 1, 17).when(F.col("key") == 2, 5000).otherwise(0)).collect()
    order = lambda i: hashlib.md5(f"s:{i}".encode()).hexdigest()
    want = [i for k, n in wanted.items() for i in sorted((i for i in range(3000) if i % 3 == k), key=order)[:n]]
    assert sorted(r.id for r in got) == sorted(want) and got[0].asDict().keys() == {"key", "id", "h"}


def test_poisson_weights(spark):
    from temblor.operators.ranking import poisson, uniform

    w = spark.range(20000).select(poisson(uniform(F.lit("x"), F.col("id")), F.lit(0.7)).alias("w")).agg(F.avg("w"), F.var_pop("w"), F.avg((F.col("w") == 0).cast("double"))).first()
    assert abs(w[0] - 0.7) < 0.03 and abs(w[1] - 0.7) < 0.04 and abs(w[2] - math.exp(-0.7)) < 0.02


def one_by_one(n, pairs):
    home, above = {}, {}
    for a, b in pairs:
        above.setdefault(b, []).append(a)
    for e in range(n):
        homes = [a for a in above.get(e, ()) if home[a] == a]
        home[e] = min(homes) if homes else e
    return home


@pytest.mark.parametrize("bound", [5, 5000])
def test_first_fit_is_the_one_by_one_order(spark, bound, monkeypatch):
    """A chain of which each would have the next, random pairs, and events by themselves; with components too large for one task too."""
    from temblor.operators import cluster

    r = random.Random(bound)
    pairs = sorted({(i, i + 1) for i in range(24)} | {tuple(sorted(r.sample(range(30, 70), 2))) for _ in range(90)})
    monkeypatch.setattr(cluster.decluster, "__defaults__", (2, bound))
    claims = spark.createDataFrame([(a, b, float(a)) for a, b in pairs], "strong long, weak long, place double")
    got = {x.event_id: x.home for x in cluster.first_fit(claims, spark.range(75).withColumnRenamed("id", "event_id")).collect()}
    assert got == one_by_one(75, pairs)


def test_moon_and_sun_on_known_dates(spark):
    from temblor.functions.sky import STEPS, with_steps

    at = lambda *d: datetime(*d, tzinfo=UTC).timestamp()
    dates = [at(2024, 1, 25, 17, 54), at(2024, 1, 11, 11, 57), at(2024, 6, 20, 20, 51), at(2024, 3, 20, 3, 6), at(2024, 3, 10, 7, 0), at(2024, 3, 23, 16, 0)]
    full, new, summer, spring, near, far = with_steps(spark.createDataFrame([(d,) for d in dates], "ep double"), STEPS).orderBy(F.expr(f"array_position(array({', '.join(f'{d}D' for d in dates)}), ep)")).collect()
    assert full.elongation > math.radians(174) and new.elongation < math.radians(6)  # within the Moon's latitude
    assert abs(math.degrees(summer.sun_dec) - 23.44) < 0.02 and abs(math.degrees(spring.sun_dec)) < 0.02
    assert abs(near.moon_m / 1e3 - 356_895) < 2500 and abs(far.moon_m / 1e3 - 406_292) < 2500  # perigee and apogee of March 2024


def test_reports(spark, tmp_path):
    from temblor.sources import reports

    text = lambda s: spark.createDataFrame([(s, "st")], "text string, station string")
    assert reports.ejections(text('[{"startTime":"2024-01-01T00:00Z","cmeAnalyses":[]},{"startTime":"2024-01-01T00:00Z"},{"cmeAnalyses":[{"speed":5}]},{"startTime":"2024-01-01T00:01Z","cmeAnalyses":[{"speed":0},{"speed":7.5}]}]')).collect()[0].value == 7.5
    assert reports.storms(text("not json")).count() == reports.wells(text("{}")).count() == reports.tides(text("[]")).count() == 0
    assert reports.storms(text('[{"allKpIndex":null},{"allKpIndex":[{"observedTime":"2024-01-01T03:00Z","kpIndex":6}]}]')).count() == 1
    gap = '{"times":["2024-01-01T00:00:00Z","2024-01-01T00:01:00Z"],"values":[{"id":"X","values":[1.5,null]}]}'
    assert [(r.metric, r.value) for r in reports.variations(text(gap)).collect()] == [("mag_x", 1.5)]
    assert reports.hotspots(text("Invalid key")).count() == reports.hotspots(text("latitude,longitude,frp")).count() == 0
    assert [(r.lat, r.brightness, r.frp) for r in reports.hotspots(text("longitude,latitude\r\n1,2\r\nx,3\r\n")).collect()] == [(2.0, 0.0, 0.0)]
    head = f"{'     1.0':60}IONEX VERSION / TYPE\r\n{'    -2':60}EXPONENT\r\n{'     0.0  10.0   5.0':60}LON1 / LON2 / DLON\r\n{'':60}END OF HEADER\r\n"
    rows = lambda v: f"{'    87.5   0.0  10.0   5.0 450.0':60}LAT/LON1/LON2/DLON/H\r\n{v}\r\n{'   -87.5   0.0  10.0   5.0 450.0':60}LAT/LON1/LON2/DLON/H\r\n  7 8\r\n  9\r\n"
    a_map = lambda n, kind, v, end=True: f"{n:6}{'':54}START OF {kind} MAP\r\n{'  2024     1     2    ' + str(n) + '     0     0':60}EPOCH OF CURRENT MAP\r\n{rows(v)}" + (f"{n:6}{'':54}END OF {kind} MAP\r\n" if end else "")
    (tmp_path / "one.txt").write_bytes((head + a_map(1, "TEC", "  100 9999  -5") + a_map(2, "TEC", "  1 2 3 4 5") + a_map(1, "RMS", "  6 6 6")).encode())
    (tmp_path / "cut.txt").write_bytes((head + a_map(1, "TEC", "  1 1 1") + a_map(2, "TEC", "  2 2 2", end=False)).encode())
    (tmp_path / "none.txt").write_text("nothing here")
    got = {}
    for r in reports.tec_maps(spark, f"{tmp_path}/*.txt").collect():
        got.setdefault((r.file.split("/")[-1], r.time.hour), set()).add((r.lat, r.lon, r.value))
    low = {(-87.5, 0.0, 0.07), (-87.5, 5.0, 0.08), (-87.5, 10.0, 0.09)}
    assert got[("one.txt", 1)] == {(87.5, 0.0, 1.0), (87.5, 10.0, -0.05)} | low and got[("one.txt", 2)] == {(87.5, 0.0, 0.01), (87.5, 5.0, 0.02), (87.5, 10.0, 0.03)} | low
    assert set(got) == {("one.txt", 1), ("one.txt", 2), ("cut.txt", 1)}


def test_flags_of_a_dense_place_are_not_paired(spark, monkeypatch):
    """Regions are those of the one-by-one order, with chains over cells, times alike and not known and places not known; what is kept grows with the places."""
    from temblor.operators import cluster
    from temblor.plans import evidence

    kept = []
    for module in (cluster, evidence):
        keep = module.checkpointed
        monkeypatch.setattr(module, "checkpointed", lambda df, keep=keep: kept.append(keep(df)) or kept[-1])
    r = random.Random(7)
    places = [(round(r.uniform(-9, 9), 2), round(r.uniform(20, 30), 2)) for _ in range(60)] + [(60.0, 179.9), (60.0, -179.9), (None, 3.0)]
    rows = [(i, None if i == 5 else float(r.randrange(0, 500)), *r.choice(places), r.choice((0.9, 0.95, 0.99))) for i in range(1200)]
    homes: list[tuple] = []
    want: dict[int, list[float]] = {}
    for i, t, lat, lon, p in sorted(rows, key=lambda x: (math.inf if x[1] is None else x[1], x[0])):
        found = next((h for h, a, o in homes if None not in (lat, lon) and math.hypot((a - lat) * 111, (o - lon) * 111 * math.cos(math.radians(a))) <= evidence.HOME_KM), i)
        if found == i and None not in (lat, lon):
            homes.append((i, lat, lon))
        want.setdefault(found, []).append(p)
    got = {x.event_id: (x.n_flags, x.peak_p) for x in evidence.watch_homes(spark.createDataFrame(rows, "event_id long, ep double, lat double, lon double, p double")).collect()}
    assert got == {h: (len(p), max(p)) for h, p in want.items()} and 12 < len(homes) < 40
    assert all(k.count() < 200 for k in kept)
