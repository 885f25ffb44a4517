"""What scores and features are worth: importance, thresholds, samples of negatives, bootstrap, regions under watch."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import KM_DEGREE
from ..operators.around import plane_km
from ..operators.cluster import strongest_first
from ..operators.graph import checkpointed
from ..operators.nearby import neighbours
from ..operators.ordered import numbered
from ..operators.ranking import by_score, first_by_hash, hash_order, poisson, quality, ranked_scores, thresholds, uniform
from ..operators.trailing import trailing_sums
from ..sources.projection import DAY, QUAKES, quakes
from .analytics import RESOLVED, resolved
from .features import BIG, HORIZON, HOURS, hours_before, zone_hours
from .registry import query
from .series import HOURLY, ZONED, hourly, over, zoned

C = F.col

AUC_SQL = """t AS (SELECT {keys}, score, count(*) AS c, sum(y) AS y FROM {rows} GROUP BY {keys}, score),
u AS (SELECT *, sum(c) OVER w AS taken, sum(y) OVER w AS hits, sum(c) OVER (PARTITION BY {keys}) AS n, sum(y) OVER (PARTITION BY {keys}) AS pos FROM t WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)),
q AS (SELECT {keys}, any_value(n) AS n, any_value(pos) AS pos, CASE WHEN any_value(pos) > 0 AND any_value(pos) < any_value(n) THEN sum(y * ((n - pos) - (taken - hits) + (c - y) / 2)) / any_value(pos * (n - pos)) END AS auc,
  CASE WHEN any_value(pos) > 0 AND any_value(pos) < any_value(n) THEN sum(y * hits / taken) / any_value(pos) END AS ap, CASE WHEN any_value(pos) > 0 AND any_value(pos) < any_value(n) THEN max(2 * hits / (taken + pos)) END AS f1 FROM u GROUP BY {keys})"""


@query(f"""WITH {RESOLVED}, r AS (SELECT zone, p AS score, CAST(outcome = 'hit' AS INT) AS y FROM resolved), {AUC_SQL.format(keys='zone', rows='r')}
SELECT zone, CAST(n AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos, round(auc, 6) AS auc, round(ap, 6) AS ap, round(f1, 6) AS f1 FROM q UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), CAST(sum(pos) AS BIGINT), round(avg(auc), 6), round(avg(ap), 6), round(avg(f1), 6) FROM q""")
def score_quality(spark, sf_dir):
    """Area under the curve, average precision and best F1 of each zone's forecasts, and their means over the zones (zone null)."""
    r = resolved(spark, sf_dir).select("zone", C("p").alias("score"), (C("outcome") == "hit").cast("int").alias("y"))
    # The counts are stored, so that the forecasts are resolved once.
    q = checkpointed(quality(ranked_scores(checkpointed(by_score(r, ["zone"], "score", "y")), ["zone"], "score", F.floor(C("score") * 20)), ["zone"]))
    means = q.agg(F.lit(None).cast("long").alias("zone"), F.sum("n").alias("n"), F.sum("pos").alias("pos"), *(F.avg(c).alias(c) for c in ("auc", "ap", "f1")))
    return q.unionByName(means).select("zone", "n", "pos", *(F.round(c, 6).alias(c) for c in ("auc", "ap", "f1")))


#: Weights of the model under test: what a zone's last day and week held, and the event itself.
MODEL = {"n_1d": 0.08, "n_7d": 0.02, "n4_7d": 0.25, "magnitude": 0.6, "depth_km": -0.002}
GROUPS = {"counts": ("n_1d", "n_7d"), "strong": ("n4_7d",), "event": ("magnitude", "depth_km")}
ROWS = f"""{ZONED}, x AS (SELECT event_id, count(*) OVER d1 AS n_1d, count(*) OVER d7 AS n_7d, count(*) FILTER (magnitude >= 4) OVER d7 AS n4_7d, magnitude, depth_km, coalesce(max(magnitude) OVER (PARTITION BY zone ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING), 0) >= 4 AS y FROM z WINDOW {over('d1', 86400)}, {over('d7', 604800)})"""
LINEAR = "round(" + " + ".join(f"{w}e0 * {n}" for n, w in MODEL.items()) + ", 6)"


def model_rows(spark, sf_dir):
    """event_id, the model's features, and y: whether a strong event follows in the zone within a day."""
    z = zoned(spark, sf_dir)
    s = trailing_sums(z, [86400, 604800], {"n": F.lit(1), "n4": (C("magnitude") >= 4).cast("int")})
    # The events of a day ahead are those of a trailing window in reversed time, without the event's own second.
    back = z.withColumn("t", -C("t"))
    ahead = trailing_sums(back, [0, 86400], {"n4": (C("magnitude") >= 4).cast("int")}).select("event_id", (C("n4_86400") > C("n4_0")).cast("int").alias("y"))
    s = s.select("event_id", C("n_86400").cast("double").alias("n_1d"), C("n_604800").cast("double").alias("n_7d"), C("n4_604800").cast("double").alias("n4_7d"))
    return s.join(z.select("event_id", "magnitude", "depth_km"), "event_id").join(ahead, "event_id")


def linear(values: dict):
    return F.round(sum((w * values[n] for n, w in MODEL.items() if n in values), F.lit(0.0)), 6)


def areas(rows, part=50):
    """Area under the curve by name; rows have name, score and y."""
    return quality(thresholds(rows, ["name"], "score", "y", F.floor(C("score") * part)), ["name"]).select("name", "auc")


SHUFFLES = " UNION ALL ".join(f"SELECT 'permuted_{n}' AS name, {LINEAR.replace('* ' + n, '* s.v')} AS score, y FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM x) a JOIN (SELECT {n} AS v, row_number() OVER (ORDER BY md5('{n}:' || event_id)) AS k FROM x) s USING (k)" for n in MODEL)
WITHOUT = " UNION ALL ".join("SELECT 'without_" + g + "' AS name, round(" + " + ".join(["0e0", *(f"{w}e0 * {n}" for n, w in MODEL.items() if n not in out)]) + ", 6) AS score, y FROM x" for g, out in GROUPS.items())
ALONE = " UNION ALL ".join(f"SELECT 'alone_{n}' AS name, CAST({n} AS DOUBLE) AS score, y FROM x" for n in MODEL)


@query(f"""WITH {ROWS}, r AS (SELECT name, score, CAST(y AS INT) AS y FROM (SELECT 'full' AS name, {LINEAR} AS score, y FROM x UNION ALL {ALONE} UNION ALL {SHUFFLES} UNION ALL {WITHOUT})), {AUC_SQL.format(keys='name', rows='r')}
SELECT q.name, round(q.auc, 6) AS auc, round(CASE WHEN q.name LIKE 'alone_%' THEN greatest(q.auc, 1 - q.auc) ELSE f.auc - q.auc END, 6) AS importance FROM q, (SELECT auc FROM q WHERE name = 'full') f""")
def feature_importance(spark, sf_dir):
    """What features are worth to a model: alone (either direction), permuted (how much the area falls), and without their group.

    A permutation joins rows by place with the same rows in the order of a hash: both places come from counts by block, and no task holds all rows."""
    x = checkpointed(model_rows(spark, sf_dir))
    values = {n: C(n) for n in MODEL}
    one = lambda name, score: x.select(F.lit(name).alias("name"), score.cast("double").alias("score"), "y")
    parts = [one("full", linear(values)), *(one(f"alone_{n}", C(n)) for n in MODEL), *(one(f"without_{g}", linear({n: C(n) for n in MODEL if n not in gone})) for g, gone in GROUPS.items())]
    placed = checkpointed(numbered(x.withColumn("all", F.lit(1)), ["all"], ["event_id"], F.floor(C("event_id") / 1000)))
    for n in MODEL:
        h = x.select(F.lit(1).alias("all"), C(n).alias("v"), hash_order(F.lit(n), C("event_id")).alias("h"))
        other = numbered(h, ["all"], ["h"], F.substring("h", 1, 3)).select("k", "v")
        parts.append(placed.join(other, "k").select(F.lit(f"permuted_{n}").alias("name"), linear(values | {n: C("v")}).alias("score"), "y"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    a = checkpointed(areas(rows))
    full = F.broadcast(a.where("name = 'full'").select(C("auc").alias("full")))
    alone = F.greatest("auc", 1 - C("auc"))
    return a.join(full).select("name", F.round("auc", 6).alias("auc"), F.round(F.when(C("name").startswith("alone_"), alone).otherwise(C("full") - C("auc")), 6).alias("importance"))


#: Negatives for each positive, and hours round a positive that are kept in any case.
RATIO, BOUNDARY = 3, 3


@query(f"""WITH {ZONED}, {HOURS}, b AS (SELECT zone, t FROM z WHERE magnitude >= {BIG}), l AS (SELECT h.zone, h.hour, count(b.t) > 0 AS pos FROM hours h LEFT JOIN b ON b.zone = h.zone AND h.hour * 3600 >= b.t - {HORIZON} * 3600 AND h.hour * 3600 < b.t GROUP BY 1, 2),
e AS (SELECT *, NOT pos AND max(CAST(pos AS INT)) OVER (PARTITION BY zone ORDER BY hour RANGE BETWEEN {BOUNDARY} PRECEDING AND {BOUNDARY} FOLLOWING) = 1 AS edge FROM l),
n AS (SELECT zone, greatest(0, {RATIO} * count(*) FILTER (pos) - count(*) FILTER (edge)) AS wanted, count(*) FILTER (pos) AS pos FROM e GROUP BY 1),
r AS (SELECT e.zone, hour, row_number() OVER (PARTITION BY e.zone ORDER BY md5(concat_ws(':', 'negative', e.zone, hour))) AS k, count(*) OVER (PARTITION BY e.zone) AS rest FROM e WHERE NOT pos AND NOT edge)
SELECT zone, hour, CASE WHEN pos THEN 'positive' ELSE 'boundary' END AS kind FROM e WHERE pos OR edge UNION ALL SELECT r.zone, hour, 'random' FROM r JOIN n USING (zone) WHERE n.pos = 0 OR k <= wanted OR wanted = 0""")
def negative_sample(spark, sf_dir):
    """Hours to learn from: all positives, the negatives within three hours of one, and as many others by hash as make three negatives a positive.

    A zone without positives, or whose boundary is enough already, keeps all its negatives, which is the rule."""
    z = zoned(spark, sf_dir)
    b = hours_before(z.where(C("magnitude") >= BIG).select("zone", "t", "magnitude"), HORIZON).select("zone", "hour").distinct()
    near = b.select("zone", F.explode(F.sequence(C("hour") - BOUNDARY, C("hour") + BOUNDARY)).alias("hour")).distinct()
    h = zone_hours(z).join(b.withColumn("pos", F.lit(True)), ["zone", "hour"], "left").join(near.withColumn("near", F.lit(True)), ["zone", "hour"], "left")
    h = checkpointed(h.select("zone", "hour", F.when(C("pos"), "positive").when(C("near"), "boundary").otherwise("random").alias("kind")))
    n = h.groupBy("zone").agg(F.count_if(C("kind") == "positive").alias("pos"), F.count_if(C("kind") == "boundary").alias("edge"))
    n = n.select("zone", "pos", F.greatest(F.lit(0), RATIO * C("pos") - C("edge")).alias("wanted"))
    rest = h.where("kind = 'random'").join(n, "zone")
    some = rest.where("pos > 0 and wanted > 0").withColumn("h", hash_order(F.lit("negative"), C("zone"), C("hour")))
    some = first_by_hash(some, ["zone"], "h", C("wanted"))
    return h.where("kind <> 'random'").unionByName(rest.where("pos = 0 or wanted = 0").select("zone", "hour", "kind")).unionByName(some.select("zone", "hour", "kind"))


#: Replicates of the bootstrap, and hours before an event over which a signal counts.
REPLICATES, BEFORE = 200, 24
BOOT = " + ".join("CASE WHEN u >= {} THEN 1 ELSE 0 END".format(" + ".join(["exp(-rate)", *(f"exp(-rate) * pow(rate, {j}) / {math.factorial(j)}e0" for j in range(1, k + 1))])) for k in range(12))


@query(f"""WITH {HOURLY}, {QUAKES}, s AS (SELECT hour, v FROM hourly WHERE metric = 'view'), e AS (SELECT CAST(floor(ep / 3600) AS BIGINT) AS hour, count(*) AS n FROM quakes WHERE magnitude >= 4.5 GROUP BY 1),
m AS (SELECT h.hour, avg(s.v) AS v FROM (SELECT hour FROM s UNION SELECT hour FROM e) h JOIN s ON s.hour BETWEEN h.hour - {BEFORE} AND h.hour GROUP BY 1),
o AS (SELECT sum(n) AS n, sum(n * v) / sum(n) AS mean FROM e JOIN m USING (hour)), k AS (SELECT count(*) AS hours FROM s),
w AS (SELECT r, v, {BOOT} AS w FROM (SELECT r, m.v, CAST('0x' || substr(md5(concat_ws(':', 'boot', r, m.hour)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u, least(2, o.n / k.hours) AS rate FROM m JOIN s USING (hour), o, k, (SELECT unnest(range({REPLICATES})) AS r))),
b AS (SELECT r, sum(w * v) / sum(w) AS mean FROM w GROUP BY 1 HAVING sum(w) > 0)
SELECT round(any_value(o.mean), 6) AS observed, round(avg(b.mean), 6) AS null_mean, round(stddev_pop(b.mean), 6) AS null_std, round((any_value(o.mean) - avg(b.mean)) / stddev_pop(b.mean), 4) AS z, round(count(*) FILTER (b.mean >= o.mean) / count(*), 6) AS p FROM b, o""")
def bootstrap_null(spark, sf_dir):
    """A signal in the day before strong events against replicates of as many random hours: each hour has a Poisson weight in each replicate from a hash, so that all replicates are one pass over the hours."""
    s = hourly(spark, sf_dir).where("metric = 'view'").select("hour", "v")
    e = quakes(spark, sf_dir).where("magnitude >= 4.5").groupBy(F.floor(C("ep") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    m = checkpointed(s.select("v", F.explode(F.sequence(C("hour"), C("hour") + BEFORE)).alias("hour")).groupBy("hour").agg(F.avg("v").alias("v")))
    o = e.join(m, "hour").agg(F.sum("n").alias("n"), (F.sum(C("n") * C("v")) / F.sum("n")).alias("observed"))
    rate = F.broadcast(o.join(s.agg(F.count("*").alias("hours"))).select("observed", F.least(F.lit(2.0), C("n") / C("hours")).alias("rate")))
    w = m.join(s.select("hour"), "hour", "left_semi").join(rate).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))))
    w = w.withColumn("w", poisson(uniform(F.lit("boot"), C("r"), C("hour")), C("rate")))
    b = w.groupBy("r", "observed").agg((F.sum(C("w") * C("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean")).where("mean is not null")
    mean, std = F.avg("mean"), F.stddev_pop("mean")
    return b.agg(F.round(F.first("observed"), 6).alias("observed"), F.round(mean, 6).alias("null_mean"), F.round(std, 6).alias("null_std"), F.round((F.first("observed") - mean) / std, 4).alias("z"), F.round(F.count_if(C("mean") >= C("observed")) / F.count("*"), 6).alias("p"))


#: Km of a region round its first flag, km and days of its hits, and the chance of a hit without skill.
HOME_KM, HIT_KM, HIT_DAYS, NULL_P = 200.0, 150.0, 10, 0.054
#: Events under watch, and strong ones, which hit.
FLAG, STRONG = 0.9, 4.5
FLAGS = f"flags AS (SELECT event_id, ep, lat, lon, ((event_id * 37) % 100) / 100.0::DOUBLE AS p, row_number() OVER (ORDER BY ep, event_id) AS k FROM quakes WHERE ((event_id * 37) % 100) / 100.0 >= {FLAG})"


def planar(a: str, b: str, at: str) -> str:
    """Kilometres in the plane, with the scale of longitude of ``at``."""
    return f"sqrt(pow(({a}.lat - {b}.lat) * 111, 2) + pow(({a}.lon - {b}.lon) * 111 * cos(radians({at}.lat)), 2))"


REGIONS = f"""{QUAKES}, {FLAGS}, w AS (SELECT 0::BIGINT AS k, CAST([] AS STRUCT(id BIGINT, lat DOUBLE, lon DOUBLE)[]) AS homes, NULL::BIGINT AS event_id, NULL::BIGINT AS home
  UNION ALL SELECT k, CASE WHEN found IS NULL THEN list_append(homes, {{'id': event_id, 'lat': lat, 'lon': lon}}) ELSE homes END, event_id, coalesce(found, event_id) FROM
  (SELECT f.k, homes, f.event_id, f.lat, f.lon, list_filter(homes, lambda r: {planar('r', 'f', 'r')} <= {HOME_KM})[1].id AS found FROM w JOIN flags f ON f.k = w.k + 1)),
g AS (SELECT home, count(*) AS n_flags, max(p) AS peak_p FROM w JOIN flags USING (event_id) GROUP BY 1), r AS (SELECT home AS region, n_flags, peak_p, ep, lat, lon FROM g JOIN flags f ON f.event_id = g.home), b AS (SELECT ep, lat, lon FROM quakes WHERE magnitude >= {STRONG}),
h AS (SELECT region, count(*) FILTER (b.ep < r.ep) > 0 AS early, count(*) FILTER (b.ep >= r.ep AND b.ep <= r.ep + {HIT_DAYS * DAY}) > 0 AS hit FROM r JOIN b ON {planar('r', 'b', 'r')} <= {HIT_KM} GROUP BY 1),
regions AS (SELECT region, n_flags, peak_p, NOT coalesce(early, false) AS predictive, coalesce(hit, false) AS hit, coalesce(hit, false) OR ep + {HIT_DAYS * DAY} <= (SELECT max(ep) FROM quakes) AS resolved FROM r LEFT JOIN h USING (region))"""


#: How much wider than in the plane a circle may be on the globe, up to 80 degrees of latitude.
WIDEN = 1.15


def in_plane():
    """Kilometres in the plane of l and r, with the scale of longitude of l."""
    return F.sqrt(F.pow(F.expr("(l.lat - r.lat) * 111"), 2) + F.pow(F.expr("(l.lon - r.lon) * 111 * cos(radians(l.lat))"), 2))


def near_in_plane(left, right, km: float):
    """Pairs within ``km`` in the plane, the scale of longitude that of the left; the globe's cells find them and the plane decides."""
    flat = lambda d: d.withColumnRenamed("ep", "time").withColumn("ep", F.lit(0.0))
    return neighbours(flat(left), flat(right), km=WIDEN * km).where(in_plane() <= km)


def watch_homes(flags):
    """event_id, ep, lat, lon, n_flags and peak_p of the flags (event_id, ep, lat, lon, p) that found a region.

    All flags of a place have one home, since homes made later come after: the place's first flag stands for all.  Those that found
    one are the mains of ``strongest_first``, the earliest as the strongest; the others join the earliest that would have them.  Pairs of flags are not rows."""
    # A flag of no known place is by itself; one of no known time comes last.
    alone = F.when(C("lat").isNull() | C("lon").isNull(), C("event_id"))
    order = F.struct(C("ep").isNull(), C("ep"), C("event_id"))
    places = flags.groupBy("lat", "lon", alone).agg(F.min(order).alias("order"), F.count("*").alias("n"), F.max("p").alias("p")).select(C("order.event_id").alias("event_id"), C("order.ep").alias("ep"), "lat", "lon", "order", "n", "p")
    places = checkpointed(places)
    rows = places.select("event_id", F.lit(0.0).alias("ep"), "lat", "lon", (-F.coalesce("ep", F.lit(float("inf")))).alias("strength"), C("event_id").alias("turn"), F.lit(HOME_KM).alias("km"), F.lit(0.0).alias("seconds"))
    places = checkpointed(places.join(strongest_first(rows, plane_km, WIDEN, 2 * WIDEN * HOME_KM / KM_DEGREE), "event_id"))
    homes, rest = places.where("main").drop("main"), places.where("not main").drop("main")
    # The edge of a circle is found a little wider, should the last digits of the two measures differ.
    near = near_in_plane(homes, rest, HOME_KM + 1e-6).select(C("r.event_id").alias("id"), C("r.n").alias("n"), C("r.p").alias("p"), C("l.event_id").alias("event_id"), F.struct(in_plane() > HOME_KM, C("l.order")).alias("order"))
    joined = near.groupBy("id", "n", "p").agg(F.min_by("event_id", "order").alias("event_id"))
    g = homes.select("event_id", "n", "p").unionByName(joined.drop("id")).groupBy("event_id").agg(F.sum("n").alias("n_flags"), F.max("p").alias("peak_p"))
    return checkpointed(homes.select("event_id", "ep", "lat", "lon").join(g, "event_id"))


def watch_table(spark, sf_dir):
    q = quakes(spark, sf_dir).select("event_id", "ep", "lat", "lon", "magnitude")
    r = watch_homes(q.withColumn("p", F.pmod(C("event_id") * 37, F.lit(100)) / 100).where(C("p") >= FLAG))
    met = near_in_plane(r, q.where(C("magnitude") >= STRONG), HIT_KM).select(C("l.event_id").alias("event_id"), F.expr("r.time - l.time").alias("after"))
    h = met.groupBy("event_id").agg(F.bool_or(C("after") < 0).alias("early"), F.bool_or((C("after") >= 0) & (C("after") <= HIT_DAYS * DAY)).alias("hit"))
    no = lambda c: F.coalesce(c, F.lit(False))
    last = F.broadcast(q.agg(F.max("ep").alias("last")))
    return r.join(h, "event_id", "left").join(last).select(C("event_id").alias("region"), "n_flags", "peak_p", (~no("early")).alias("predictive"), no("hit").alias("hit"), (no("hit") | (C("ep") + HIT_DAYS * DAY <= C("last"))).alias("resolved"))


@query(f"WITH RECURSIVE {REGIONS} SELECT * FROM regions")
def watch_regions(spark, sf_dir):
    """Flagged events, in order of time, join the first region within 200 km or found one; a region is predictive if nothing strong came before its first flag."""
    return watch_table(spark, sf_dir)


@query(f"""WITH RECURSIVE {REGIONS}, c AS (SELECT count(*) AS regions, count(*) FILTER (predictive) AS predictive, count(*) FILTER (predictive AND resolved) AS n, count(*) FILTER (predictive AND resolved AND hit) AS hits FROM regions)
SELECT regions, predictive, n, hits, round(hits / greatest(n, 1), 3) AS hit_rate, round(n * {NULL_P}::DOUBLE, 2) AS expected, CASE WHEN hits = 0 THEN 1 ELSE round((SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({NULL_P}) + (n - k) * ln(1 - {NULL_P}))) FROM (SELECT unnest(range(hits, n + 1)) AS k)), 6) END AS p FROM c""")
def watch_skill(spark, sf_dir):
    """Hits of predictive regions against the binomial chance of as many without skill; the tail is summed from the logarithms of its terms."""
    r = watch_table(spark, sf_dir)
    both = C("predictive") & C("resolved")
    c = r.agg(F.count("*").alias("regions"), F.count_if("predictive").alias("predictive"), F.count_if(both).alias("n"), F.count_if(both & C("hit")).alias("hits"))
    # A term's logarithm is that of the one before, and the ratio of the two.
    k = F.explode(F.sequence(F.lit(0).cast("long"), C("n")))
    rise = F.when(C("k") == 0, C("n") * F.log(F.lit(1 - NULL_P))).otherwise(F.log((C("n") - C("k") + 1) / C("k")) + F.log(F.lit(NULL_P / (1 - NULL_P))))
    terms = c.select("*", k.alias("k")).withColumn("log", F.sum(rise).over(Window.partitionBy("regions").orderBy("k")))
    p = terms.groupBy("regions", "predictive", "n", "hits").agg(F.sum(F.when(C("k") >= C("hits"), F.exp("log"))).alias("p"))
    return p.select("regions", "predictive", "n", "hits", F.round(C("hits") / F.greatest("n", F.lit(1)), 3).alias("hit_rate"), F.round(C("n") * NULL_P, 2).alias("expected"), F.when(C("hits") == 0, 1.0).otherwise(F.round("p", 6)).alias("p"))


@query(f"""WITH {QUAKES}, {FLAGS}, b AS (SELECT event_id, ep, lat, lon FROM quakes WHERE magnitude >= {STRONG}), j AS (SELECT b.event_id, b.ep, f.ep AS flag FROM b JOIN flags f ON f.event_id <> b.event_id AND f.ep < b.ep AND f.ep >= b.ep - {30 * DAY} AND {planar('f', 'b', 'b')} <= 100)
SELECT b.event_id, count(flag) > 0 AS flagged_before, count(flag) AS n_prior, round((any_value(b.ep) - min(flag)) / 3600, 1) AS lead_hours FROM b LEFT JOIN j USING (event_id) GROUP BY 1""")
def flag_recall(spark, sf_dir):
    """Strong events, and the flags within 100 km and 30 days before them."""
    q = quakes(spark, sf_dir).select("event_id", "ep", "lat", "lon", "magnitude")
    f = q.where(F.pmod(C("event_id") * 37, F.lit(100)) / 100 >= FLAG)
    b = q.where(C("magnitude") >= STRONG)
    plane = F.sqrt(F.pow(F.expr("(l.lat - r.lat) * 111"), 2) + F.pow(F.expr("(l.lon - r.lon) * 111 * cos(radians(l.lat))"), 2))
    j = neighbours(b, f, km=115, back=30 * DAY).where((plane <= 100) & (F.expr("r.ep < l.ep")) & F.expr("l.event_id <> r.event_id")).groupBy(C("l.event_id").alias("event_id")).agg(F.count("*").alias("n_prior"), F.min("r.ep").alias("flag"))
    return b.join(j, "event_id", "left").select("event_id", C("n_prior").isNotNull().alias("flagged_before"), F.coalesce("n_prior", F.lit(0)).alias("n_prior"), F.round((C("ep") - C("flag")) / 3600, 1).alias("lead_hours"))
