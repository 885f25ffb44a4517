"""A ledger of forecasts as a stream: issued, superseded, hit or expired, by zone, in event time.

Two streams come together by zone: scores of zones and strong events, in any order and more than once (see ``ordered``).  What is kept of a zone are its open forecasts.

A score of at least ``LEAST`` opens a forecast unless one is open that ends later, in which case it needs ``AGAIN`` times that one's
probability and supersedes it.  The first strong event from a forecast's issue to its end, both included, is its hit; a
forecast whose end the watermark has passed without one is a false alarm.  Of one second, scores come before events,
each by id.  Only closed forecasts are given; open ones stay in the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import InOrder, in_order

#: The least probability of a forecast, and the rise that issues one anew.
LEAST, AGAIN = 0.35, 1.1
#: How late a row may be.
DELAY = 7200
SCORE, EVENT = 0, 1

ROWS = "kind int, id long, zone long, t long, x double, hours long, guess double"
CLOSED = "zone long, fid long, issued long, expires long, p double, guess double, outcome string, closed long, event_id long, actual double"
WAITING = "t long, kind int, id long, x double, hours long, guess double"
OPEN = "fid long, issued long, expires long, p double, guess double"


def judge(rows: list[tuple], forecasts: list[tuple], until: float) -> tuple[list[tuple], list[tuple]]:
    """(closed, still open) after rows (kind, id, t, x, hours, guess) in order of t, kind and id, and the end of time ``until``.

    Open forecasts are (fid, issued, expires, p, guess); closed ones have (outcome, time, event, magnitude) behind that."""
    closed = []

    def close(which, *how):
        for f in [f for f in forecasts if which(f)]:
            forecasts.remove(f)
            closed.append((*f, *how))

    for kind, ident, t, x, hours, guess in rows:
        for f in [f for f in forecasts if f[2] < t]:
            close(lambda g, f=f: g is f, "false_alarm", f[2], None, None)
        if kind == EVENT:
            close(lambda f, t=t: f[1] <= t <= f[2], "hit", t, ident, x)
            continue
        best = max((f[3] for f in forecasts if f[2] > t), default=None)
        if x >= LEAST and (best is None or x >= best * AGAIN):
            close(lambda f, t=t: f[2] > t, "superseded", t, None, None)
            forecasts.append((ident, t, t + hours * 3600, x, guess))
    for f in [f for f in forecasts if f[2] < until]:
        close(lambda g, f=f: g is f, "false_alarm", f[2], None, None)
    return closed, forecasts


def fold(rows: list[tuple], forecasts: list[tuple], until: float) -> tuple[list[tuple], list[tuple], float | None]:
    closed, forecasts = judge([(k, i, t, x, h, g) for t, k, i, x, h, g in rows], forecasts, until)
    return closed, forecasts, min((f[2] for f in forecasts), default=None)


def ledger(rows: DataFrame) -> DataFrame:
    """Closed forecasts of a stream of ROWS: scores (x is the probability, hours the window, guess the expected magnitude) and strong events (x is the magnitude; hours and guess 0).

    What can't change the ledger should be filtered before; rows without zone, time or value are left out."""
    return in_order(rows.where("x is not null"), "zone", InOrder(WAITING, OPEN, CLOSED, fold), DELAY)


def metrics(closed: DataFrame) -> DataFrame:
    """By window of hours, and over all (null): forecasts, outcomes, rates of all that were closed, mean lead in hours and mean error of the magnitude over hits."""
    f = closed.withColumns({"hours": ((F.col("expires") - F.col("issued")) / 3600).cast("long"), "lead": F.when(F.col("outcome") == "hit", (F.col("closed") - F.col("issued")) / 3600)})
    of = lambda outcome: F.count_if(F.col("outcome") == outcome)
    rate = lambda outcome: F.round(of(outcome) / F.count("*"), 3)
    return f.groupingSets([["hours"], []], "hours").agg(
        F.count("*").alias("n"), of("hit").alias("hits"), of("false_alarm").alias("false_alarms"), of("superseded").alias("superseded"),
        rate("hit").alias("hit_rate"), rate("false_alarm").alias("false_alarm_rate"), F.round(F.avg("lead"), 1).alias("lead_hours"), F.round(F.avg(F.abs(F.col("guess") - F.col("actual"))), 2).alias("magnitude_error"),
    )
