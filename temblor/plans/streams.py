"""Streams that get their rows in parts, some late and some twice, against SQL that says which rows count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import gk_sql, haversine_sql
from ..operators.graph import shared_dir
from ..sources.projection import DAY, QUAKES, quakes
from ..streaming import ledger, live, scores, watch
from ..streaming.ordered import delivered
from .analytics import FORECASTS, forecasts
from .registry import query
from .hazards import BACK, CHANGE
from .series import ZONED, zoned
from .waves import BUOYS, buoys

#: Deliveries: three of ten days each; a row whose id is divisible by 11 comes one later, by 5 again with the next one, by 7 twice.
START, PART, PARTS = 1704067200, 864000, 3


def arrivals(rows: DataFrame, t: str, ident: str) -> DataFrame:
    """Rows with the number of the delivery that they come with, as often as they come."""
    k = F.col(ident)
    first = F.least(F.lit(PARTS - 1), F.floor((F.col(t) - START) / PART) + (k % 11 == 0).cast("int"))
    twice = F.when(k % 7 == 0, F.array(first)).otherwise(F.array().cast("array<bigint>"))
    again = F.when(k % 5 == 0, F.array(F.least(F.lit(PARTS - 1), first + 1))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("delivery", F.explode(F.concat(F.array(first), twice, again)))


def parts(rows: DataFrame) -> list[DataFrame]:
    return [rows.where(F.col("delivery") == k).drop("delivery") for k in range(PARTS)]


def arrivals_sql(rows: str, t: str, ident: str) -> str:
    first = f"least({PARTS - 1}, CAST(floor(({t} - {START}) / {PART}) AS BIGINT) + CASE WHEN {ident} % 11 = 0 THEN 1 ELSE 0 END)"
    return f"SELECT * EXCLUDE (f), unnest(list_concat([f], CASE WHEN {ident} % 7 = 0 THEN [f] ELSE [] END, CASE WHEN {ident} % 5 = 0 THEN [least({PARTS - 1}, f + 1)] ELSE [] END)) AS delivery FROM (SELECT *, {first} AS f FROM {rows})"


def waters_sql(rows: str, delay: int, t: str = "t") -> str:
    """w(delivery, mark): the watermark before each delivery, and after the last."""
    return f"w AS (SELECT k AS delivery, (SELECT max({t}) FROM {rows} r WHERE r.delivery < k) - {delay} AS mark FROM (SELECT unnest(range({PARTS + 1})) AS k))"


#: From this magnitude on an event hits a forecast.
STRONG = 4.5
LEDGER = f"""{ZONED}, {FORECASTS}, s AS (SELECT 0 AS kind, fid AS id, zone, CAST(issued AS BIGINT) AS t, p AS x, hours, round(4.5 + (fid * 13 % 20) / 10.0, 1) AS guess FROM forecasts WHERE p >= {ledger.LEAST}
  UNION ALL SELECT 1, event_id, zone, t, magnitude, 0, 0 FROM z WHERE magnitude >= {STRONG}),
r AS ({arrivals_sql("s", "t", "id")}), {waters_sql("r", ledger.DELAY)}, latest AS (SELECT mark FROM w WHERE delivery = {PARTS}),
ok AS (SELECT DISTINCT kind, id, zone, t, x, hours, guess FROM r JOIN w USING (delivery), latest WHERE (w.mark IS NULL OR t > w.mark) AND t <= latest.mark),
f AS (SELECT id, zone, t, x, guess, t + hours * 3600 AS expires FROM ok WHERE kind = 0),
h AS (SELECT f.id, arg_min(e.id, struct_pack(t := e.t, id := e.id)) AS event_id, arg_min(e.x, struct_pack(t := e.t, id := e.id)) AS actual, min(e.t) AS hit FROM f JOIN ok e ON e.kind = 1 AND e.zone = f.zone AND e.t BETWEEN f.t AND f.expires GROUP BY 1),
g AS (SELECT f.*, event_id, actual, hit FROM f LEFT JOIN h USING (id)),
nx AS (SELECT g.id, arg_min(n.id, struct_pack(t := n.t, id := n.id)) AS next_id, min(n.t) AS next_t FROM g JOIN g n ON n.zone = g.zone AND (n.t > g.t OR (n.t = g.t AND n.id > g.id)) AND (n.t >= g.expires OR n.t > g.hit OR n.x >= g.x * {ledger.AGAIN}) GROUP BY 1),
chain AS (SELECT arg_min(id, struct_pack(t := t, id := id)) AS id FROM f GROUP BY zone UNION ALL SELECT next_id FROM chain JOIN nx USING (id)),
o AS (SELECT zone, id AS fid, t AS issued, expires, x AS p, guess, CASE WHEN next_t < expires AND NOT coalesce(hit < next_t, false) THEN 'superseded' WHEN hit IS NOT NULL THEN 'hit' WHEN expires < (SELECT mark FROM latest) THEN 'false_alarm' ELSE 'pending' END AS outcome, next_t, hit, event_id, actual FROM chain JOIN g USING (id) LEFT JOIN nx USING (id)),
closed AS (SELECT zone, fid, issued, expires, p, CAST(guess AS DOUBLE) AS guess, outcome, CASE outcome WHEN 'superseded' THEN next_t WHEN 'hit' THEN hit ELSE expires END AS closed, CASE WHEN outcome = 'hit' THEN event_id END AS event_id, CASE WHEN outcome = 'hit' THEN actual END AS actual FROM o WHERE outcome <> 'pending')"""


def closed_forecasts(spark, sf_dir) -> DataFrame:
    f = forecasts(spark, sf_dir).where(F.col("p") >= ledger.LEAST)
    f = f.select(F.lit(ledger.SCORE).alias("kind"), F.col("fid").alias("id"), "zone", F.col("issued").alias("t"), F.col("p").alias("x"), "hours", F.round(4.5 + F.col("fid") * 13 % 20 / 10, 1).alias("guess"))
    e = zoned(spark, sf_dir).where(F.col("magnitude") >= STRONG).select(F.lit(ledger.EVENT).alias("kind"), F.col("event_id").alias("id"), "zone", "t", F.col("magnitude").alias("x"), F.lit(0).alias("hours"), F.lit(0.0).alias("guess"))
    rows = f.unionByName(e)
    names = [c.split() for c in ledger.ROWS.split(", ")]
    rows = arrivals(rows.select(*(F.col(n).cast(kind) for n, kind in names)), "t", "id")
    return delivered(spark, parts(rows), ledger.ROWS, ledger.ledger, "ledger")


@query(f"WITH RECURSIVE {LEDGER} SELECT * FROM closed")
def forecast_ledger(spark, sf_dir):
    """Forecasts of a stream of scores and strong events: issued, superseded, hit or expired."""
    return closed_forecasts(spark, sf_dir)


@query(f"""WITH RECURSIVE {LEDGER}, m AS (SELECT *, CAST((expires - issued) // 3600 AS BIGINT) AS hours FROM closed) SELECT hours, count(*) AS n, count(*) FILTER (outcome = 'hit') AS hits, count(*) FILTER (outcome = 'false_alarm') AS false_alarms, count(*) FILTER (outcome = 'superseded') AS superseded,
  round(count(*) FILTER (outcome = 'hit') / count(*), 3) AS hit_rate, round(count(*) FILTER (outcome = 'false_alarm') / count(*), 3) AS false_alarm_rate, round(avg((closed - issued) / 3600) FILTER (outcome = 'hit'), 1) AS lead_hours, round(avg(abs(guess - actual)), 2) AS magnitude_error FROM m GROUP BY GROUPING SETS ((hours), ())""")
def ledger_metrics(spark, sf_dir):
    """What became of the ledger's forecasts, by window and over all."""
    return ledger.metrics(closed_forecasts(spark, sf_dir))


#: Fixed values of the score: base, and weights of the day's and the week's number, the strongest before and the event itself.
BASE, WEIGHTS = -6.0, (0.08, 0.02, 0.35, 0.6)
FACTORS = ("n_24h", "n_7d", "top", "magnitude")


def score():
    """Probability of an escalation by a logistic of the features."""
    return F.round(1 / (1 + F.exp(-(BASE + sum(w * F.col(c) for w, c in zip(WEIGHTS, FACTORS, strict=True))))), 6)


@query(f"""WITH {QUAKES}, m AS (SELECT max(ep) AS now FROM quakes), a AS (SELECT quakes.* FROM quakes, m WHERE ep > now - {scores.KEEP}),
n AS (SELECT a.event_id, count(*) FILTER (a.ep - b.ep <= {DAY}) AS n_24h, count(*) FILTER (a.ep - b.ep <= {7 * DAY}) AS n_7d, count(*) AS n_30d, max(b.magnitude) AS top, min(a.ep - b.ep) AS since FROM a JOIN quakes b ON b.ep < a.ep AND b.ep >= a.ep - {30 * DAY} AND abs(a.lat - b.lat) <= 2.8 AND {haversine_sql("a", "b")} <= {gk_sql("a.magnitude")} GROUP BY 1),
f AS (SELECT event_id, ep, magnitude, coalesce(n_24h, 0) AS n_24h, coalesce(n_7d, 0) AS n_7d, coalesce(n_30d, 0) AS n_30d, coalesce(top, 0) AS top, round(coalesce(since / 3600, 999), 6) AS hours_since FROM a LEFT JOIN n USING (event_id))
SELECT *, round(1 / (1 + exp(-({BASE}::DOUBLE + {WEIGHTS[0]}::DOUBLE * n_24h + {WEIGHTS[1]}::DOUBLE * n_7d + {WEIGHTS[2]}::DOUBLE * top + {WEIGHTS[3]}::DOUBLE * magnitude))), 6) AS score FROM f""")
def score_on_arrival(spark, sf_dir):
    """The rolling table of scores after deliveries with late and repeated rows: what one batch of all events gives."""
    rows = arrivals(quakes(spark, sf_dir).select("event_id", "ep", "lat", "lon", "magnitude"), "ep", "event_id")
    scorer = scores.Scorer(shared_dir(spark, "scores"), score())
    run_scorer(spark, scorer, parts(rows))
    return scorer.table(spark)


def run_scorer(spark, scorer: scores.Scorer, batches: list[DataFrame]) -> None:
    source = f"{scorer.path}/in"
    for batch in batches:
        batch.write.mode("append").parquet(source)
        stream = spark.readStream.schema(scores.EVENTS).parquet(source)
        stream.writeStream.foreachBatch(scorer).option("checkpointLocation", f"{scorer.path}/state").trigger(availableNow=True).start().awaitTermination()


EVENTS = "event_id long, t double, magnitude double, zone long, lat double, lon double, agency long"


def deliveries(spark, sf_dir) -> list[DataFrame]:
    """Events as they come in; every fifth id is of another agency."""
    z = zoned(spark, sf_dir).select("event_id", F.col("ep").alias("t"), "magnitude", "zone", "lat", "lon", F.floor(F.col("event_id") % 5 / 3).alias("agency"))
    return parts(arrivals(z, "t", "event_id"))


def timed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("time", F.timestamp_micros(F.round(F.col("t") * 1_000_000).cast("long")))


ARRIVED = f"""{ZONED}, e AS (SELECT event_id, ep AS t, magnitude, zone, lat, lon, CAST(floor(event_id % 5 / 3) AS BIGINT) AS agency, CAST(floor(ep * 1000) AS BIGINT) AS ms FROM z), r AS ({arrivals_sql("e", "t", "event_id")})"""


@query(f"""WITH {ARRIVED}, {waters_sql("r", 6 * 3600 * 1000, "ms")}, k AS (SELECT r.*, CAST(floor(t / 3600) AS BIGINT) AS hour FROM r JOIN w USING (delivery) WHERE mark IS NULL OR (floor(t / 3600) + 1) * 3600000 > mark)
SELECT zone, hour, count(*) AS n, max(magnitude) AS top FROM k WHERE (hour + 1) * 3600000 <= (SELECT mark FROM w WHERE delivery = {PARTS}) GROUP BY 1, 2""")
def stream_late_counts(spark, sf_dir):
    """Hours of a zone, given once the watermark has passed them and then forgotten; rows of hours that are past are left out, rows that come twice count twice."""
    return delivered(spark, deliveries(spark, sf_dir), EVENTS, lambda s: live.hourly_counts(timed(s)), "counts")


@query(f"""WITH {ARRIVED}, {waters_sql("r", int(DAY * 1000), "ms")} SELECT DISTINCT event_id, magnitude, zone FROM r JOIN w USING (delivery) WHERE mark IS NULL OR ms > mark""")
def stream_first_of_repeats(spark, sf_dir):
    """The first report of each event, of deliveries with late and repeated ones."""
    return delivered(spark, deliveries(spark, sf_dir), EVENTS, lambda s: live.first_reports(timed(s)).select("event_id", "magnitude", "zone"), "first")


def ok_sql(delay: int) -> str:
    """Rows that count: each once, not late, and judged by the end."""
    return f"{waters_sql('r', delay * 1000, 'ms')}, ok AS (SELECT DISTINCT r.* EXCLUDE (delivery) FROM r JOIN w USING (delivery) WHERE (mark IS NULL OR ms > mark) AND ms <= (SELECT mark FROM w WHERE delivery = {PARTS}))"


@query(f"""WITH {ARRIVED}, {ok_sql(watch.DELAY)} SELECT a.event_id, min(b.event_id) IS NULL AS kept, arg_min(b.event_id, struct_pack(t := b.t, id := b.event_id)) AS twin FROM ok a LEFT JOIN ok b ON b.agency <> a.agency AND (b.t < a.t OR (b.t = a.t AND b.event_id < a.event_id)) AND b.t >= a.t - {watch.TWIN_S}
  AND abs(a.lat - b.lat) <= {watch.TWIN_DEG} AND abs(a.lon - b.lon) <= {watch.TWIN_DEG} AND abs(a.magnitude - b.magnitude) <= {watch.TWIN_MAG} + 1e-9 AND {haversine_sql("a", "b")} <= {watch.TWIN_KM} GROUP BY 1""")
def stream_twins(spark, sf_dir):
    """Reports of an event that another agency has reported before: found as they come in, by cells of a degree whose state is what the watermark has not passed."""
    return delivered(spark, deliveries(spark, sf_dir), EVENTS, watch.twins, "twins")


@query(f"""WITH {FORECASTS}, e AS (SELECT fid, zone, issued AS t, p, CAST(issued * 1000 AS BIGINT) AS ms FROM forecasts), r AS ({arrivals_sql("e", "t", "fid")}), {ok_sql(watch.DELAY)},
c AS (SELECT a.fid, a.zone, a.p, arg_min(b.p, struct_pack(x := abs(b.t - a.t + {BACK}), y := b.t, z := b.fid)) AS prior FROM ok a LEFT JOIN ok b ON b.zone = a.zone AND b.t < a.t AND b.t >= a.t - {2 * BACK} GROUP BY 1, 2, 3)
SELECT zone, fid, prior, round(coalesce(p - prior, 0), 3) AS delta, CASE WHEN prior IS NULL THEN 'NEW' WHEN p - prior > {CHANGE} THEN 'RISING' WHEN p - prior < -{CHANGE} THEN 'FALLING' ELSE 'STEADY' END AS direction FROM c""")
def stream_velocity(spark, sf_dir):
    """A zone's probability against its earlier one about six hours back, as forecasts come in; what is kept of a zone is its trail."""
    f = forecasts(spark, sf_dir).select("fid", "zone", F.col("issued").alias("t"), "p")
    return delivered(spark, parts(arrivals(f, "t", "fid")), "fid long, zone long, t long, p double", watch.velocity, "velocity").withColumn("delta", F.round("delta", 3))


@query(f"""WITH {BUOYS}, e AS (SELECT *, t * 1000 AS ms FROM buoys), r AS ({arrivals_sql("e", "t", "event_id")}), {ok_sql(watch.DELAY)}, l AS (SELECT *, lag(mode) OVER o AS before, max(CASE WHEN mode = 1 THEN t END) OVER o AS last_normal FROM ok WINDOW o AS (PARTITION BY station ORDER BY t, event_id))
SELECT station, t, CASE mode WHEN 2 THEN 'EVENT' ELSE 'TSUNAMI' END AS mode, last_normal FROM l WHERE mode > 1 AND mode IS DISTINCT FROM before""")
def stream_modes(spark, sf_dir):
    """Buoys that change to event or tsunami mode, and when they last were normal."""
    b = buoys(spark, sf_dir).select("station", "t", "event_id", "mode")
    return delivered(spark, parts(arrivals(b, "t", "event_id")), "station long, t long, event_id long, mode int", watch.modes, "modes")
