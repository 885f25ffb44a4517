"""Folds over streams in order: twins of two agencies, trails of probabilities, modes of buoys, alerts."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.around import arc_km
from .ordered import InOrder, in_order

#: How late a row may be, in seconds.
DELAY = 7200
#: Twins: seconds, degrees, magnitudes and kilometres between two reports of one event.
TWIN_S, TWIN_DEG, TWIN_MAG, TWIN_KM = 43200, 0.5, 0.5, 50.0
#: Trail: seconds back to the point of comparison, the change that counts, and seconds that a trail reaches back.
BACK, CHANGE, KEEP = 6 * 3600, 0.01, 48 * 3600
MODES = {2: "EVENT", 3: "TSUNAMI"}


#: Degrees of the cells in which reports are judged, and pairs looked at in one go.
CELL, AT_ONCE = 5, 1 << 18


def twin_fold(rows: list[tuple], past: list[tuple], until: float) -> tuple[list[tuple], list[tuple], None]:
    """Rows (t, id, own, agency, magnitude, lat, lon); ``own`` rows ask, all rows answer.

    All that ask look at the first reports of their window together, then those without a twin at the next, each time at more of them."""
    if not rows:
        return [], past, None
    whole = [*past, *rows]
    t, own, agency, magnitude, lat, lon = (np.array([r[n] for r in whole], dtype=np.float64) for n in (0, 2, 3, 4, 5, 6))
    start = np.searchsorted(t, t - TWIN_S, "left")
    asks = len(past) + np.flatnonzero(own[len(past) :])
    twin, todo, at, width = np.full(len(t), -1), asks, start[asks], 4
    while len(todo):
        some = max(1, AT_ONCE // width)
        for k in range(0, len(todo), some):
            a = todo[k : k + some]
            b = at[k : k + some, None] + np.arange(width)
            met = b < a[:, None]
            b = np.where(met, b, 0)
            # A report of no known agency is of no other one.
            met &= (agency[b] < agency[a, None]) | (agency[b] > agency[a, None])
            for values, most in ((magnitude, TWIN_MAG + 1e-9), (lat, TWIN_DEG), (lon, TWIN_DEG)):
                met &= np.abs(values[b] - values[a, None]) <= most
            i, j = np.nonzero(met)
            met[i, j] = arc_km(lat[a[i]], lon[a[i]], lat[b[i, j]], lon[b[i, j]]) <= TWIN_KM
            hit = met.any(axis=1)
            twin[a[hit]] = b[hit, met[hit].argmax(axis=1)]
        at = at + width
        left = (twin[todo] < 0) & (at < todo)
        todo, at, width = todo[left], at[left], min(4 * width, 1024)
    found = [(whole[i][1], int(k < 0), None if k < 0 else whole[k][1]) for i, k in zip(asks.tolist(), twin[asks].tolist(), strict=True)]
    return found, whole[start[-1] :], None


def posted(events: DataFrame) -> DataFrame:
    """Each report in its own cell, where it asks, and in the others that the box round it touches, where it only answers; 1.44 rows a report on average."""
    cell = lambda x: F.floor(x / CELL)
    # A little wider, for the last digit.
    touched = lambda c: F.explode(F.sequence(cell(F.col(c) - TWIN_DEG - 1e-9), cell(F.col(c) + TWIN_DEG + 1e-9)))
    rows = events.select("t", F.col("event_id").alias("id"), "agency", "magnitude", "lat", "lon", touched("lat").alias("y")).withColumn("x", touched("lon"))
    # Neighbouring cells never wrap, as the box of degrees does not.
    return rows.withColumns({"cell": F.col("y") * 1000 + F.col("x"), "own": ((F.col("y") == cell(F.col("lat"))) & (F.col("x") == cell(F.col("lon")))).cast("int")})


def twins(events: DataFrame) -> DataFrame:
    """event_id, kept (no report of another agency came before it nearby) and twin (the first that did).

    Cells are judged apart; the state of a cell is what the last hours brought there."""
    rows = "t double, id long, own int, agency long, magnitude double, lat double, lon double"
    found = in_order(posted(events), "cell", InOrder(rows, rows, "cell long, event_id long, kept int, twin long", twin_fold), DELAY)
    return found.select("event_id", (F.col("kept") == 1).alias("kept"), "twin")


def trail_fold(rows: list[tuple], trail: list[tuple], until: float) -> tuple[list[tuple], list[tuple], None]:
    """Rows (t, fid, p), trail (t, p): a second's first row is its point.  The trail is in order, so that the points on both sides of the point of comparison are found by halving."""
    out, trail = [], list(trail)
    for t, fid, p in rows:
        at = bisect_left(trail, (t - BACK,))
        near = min((x for x in trail[max(at - 1, 0) : at + 1] if x[0] < t and abs(x[0] - t + BACK) <= BACK), key=lambda x: (abs(x[0] - t + BACK), x[0]), default=None)
        change = 0.0 if near is None else p - near[1]
        out.append((fid, None if near is None else near[1], change, "NEW" if near is None else "RISING" if change > CHANGE else "FALLING" if change < -CHANGE else "STEADY"))
        if not trail or trail[-1][0] != t:
            trail.append((t, p))
    return out, trail[bisect_left(trail, (rows[-1][0] - KEEP,)) :] if rows else trail, None


def velocity(forecasts: DataFrame) -> DataFrame:
    """zone, fid, prior, delta and direction of a stream (zone, fid, t, p)."""
    return in_order(forecasts, "zone", InOrder("t long, fid long, p double", "t long, p double", "zone long, fid long, prior double, delta double, direction string", trail_fold), DELAY)


def mode_fold(rows: list[tuple], kept: list[tuple], until: float) -> tuple[list[tuple], list[tuple], None]:
    """Rows (t, id, mode), kept (mode, last normal time) or nothing."""
    mode, normal = kept[0] if kept else (None, None)
    out = []
    for t, _, now in rows:
        if now == 1:
            normal = t
        elif now != mode:
            out.append((t, MODES.get(now, "?"), normal))
        mode = now
    return out, [(mode, normal)] if mode is not None else [], None


def modes(readings: DataFrame) -> DataFrame:
    """station, t, mode and last_normal of changes of a stream (station, t, event_id, mode)."""
    return in_order(readings, "station", InOrder("t long, event_id long, mode int", "mode int, normal long", "station long, t long, mode string, last_normal long", mode_fold), DELAY)
