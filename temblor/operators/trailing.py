"""Sums over trailing windows of time, as differences of running sums.

A moving frame adds up its whole window anew for each row, in one task a zone.  Here each row asks for the zone's running
sum at its own time and just before each window's start.  Running sums are made within blocks of time, and the
sums of the blocks before are added from a table of one row a zone and block: the work grows with the rows, whatever the
window, and a zone with many rows is dealt out by its blocks.

Sums of whole numbers and decimals are exact; give amounts of very different sizes as decimals, since differences of
running sums of doubles lose what is small beside the greatest."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .around import across

#: Seconds.
BLOCK = 86400


def trailing_sums(events: DataFrame, windows: list[int], sums: dict[str, Column]) -> DataFrame:
    """event_id and, for each sum and window of seconds, ``{name}_{seconds}``: the sum over the events of the zone with t in
    [own t - seconds, own t], the event itself and others of its second included.

    events has zone, t (whole seconds) and event_id, which is unique; amounts that are null count as 0; a null zone is a zone like others."""
    edges = F.explode(F.array(F.lit(0), *(F.lit(w + 1) for w in windows)))
    rows = events.select("zone", "event_id", "t", *(c.alias(n) for n, c in sums.items())).withColumn("edge", edges)
    # Only the row at an event's own time brings an amount.
    rows = rows.withColumns({"t": F.col("t") - F.col("edge"), **{n: F.when(F.col("edge") == 0, F.col(n)) for n in sums}}).withColumn("block", F.floor(F.col("t") / BLOCK))
    rows = rows.withColumn("zone", F.struct("zone"))  # a struct is never null, so that its rows meet in the join
    so_far = Window.partitionBy("zone", "block").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("zone").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("zone", "block").agg(*(F.sum(n).alias(n) for n in sums))
    blocks = blocks.select("zone", "block", *(F.sum(n).over(earlier).alias(f"{n}_before") for n in sums))
    inside = rows.select("zone", "block", "event_id", "edge", *(F.sum(n).over(so_far).alias(n) for n in sums))
    total = lambda n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"{n}_before"), F.lit(0))
    running = inside.join(blocks, ["zone", "block"]).select("event_id", "edge", *(total(n).alias(n) for n in sums))
    at = lambda n, edge: F.max(F.when(F.col("edge") == edge, F.col(n)))
    return running.groupBy("event_id").agg(*((at(n, 0) - at(n, w + 1)).alias(f"{n}_{w}") for n in sums for w in windows))


def trailing_extrema(events: DataFrame, windows: list[int], value: str) -> DataFrame:
    """event_id and, for each window of seconds, ``low_{seconds}`` and ``high_{seconds}`` of value, over the same windows.

    With blocks as long as the window, a window is the end of one block and the start of the next: the extrema up to the event's
    own time and those from the window's start on are running ones, and need no moving frame."""
    sides = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(own).alias("own")) for w in windows for own in (True, False)))
    rows = events.select("zone", "event_id", "t", F.col(value).alias("v")).select("zone", "event_id", "t", "v", F.inline(sides))
    rows = rows.withColumns({"t": F.when(F.col("own"), F.col("t")).otherwise(F.col("t") - F.col("w")), "v": F.when(F.col("own"), F.col("v"))})
    rows = rows.withColumn("block", F.floor(F.col("t") / (F.col("w") + 1)))
    block = Window.partitionBy("zone", "w", "block")
    until, since = (block.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow) for order in (F.asc("t"), F.desc("t")))
    running = lambda fn: F.when(F.col("own"), fn("v").over(until)).otherwise(fn("v").over(since))
    ends = rows.select("event_id", "w", running(F.min).alias("low"), running(F.max).alias("high"))
    of = lambda fn, c, w: fn(F.when(F.col("w") == w, F.col(c))).alias(f"{c}_{w}")
    return ends.groupBy("event_id").agg(*(of(fn, c, w) for w in windows for fn, c in ((F.min, "low"), (F.max, "high"))))


def _judged(asks: pa.Table, rows: pa.Table) -> pa.Table:
    start, order = asks["__start"].to_numpy(), np.argsort(rows["__at"].to_numpy(), kind="stable")
    at, v = rows["__at"].to_numpy()[order], rows["__v"].to_numpy(zero_copy_only=False)[order]
    lo, hi = np.searchsorted(at, start, "left"), np.searchsorted(at, start + asks["span"].to_numpy(), "right")
    none = hi <= lo
    most = across(np.maximum, v, lo, hi)
    first = at[np.minimum(lo, len(at) - 1)] if len(at) else np.zeros(len(lo), dtype=np.int64)
    return asks.drop_columns(["__start", "__block"]).append_column("most", pa.array(most, pa.float64(), mask=none)).append_column("first", pa.array(first, pa.int64(), mask=none))


def windows_ahead(points: DataFrame, events: DataFrame, key: list[str], start: Column, value: str) -> DataFrame:
    """points with ``most`` of value and ``first``, the least t, over the events of its key with t in [start, start + span]; null where there is none.

    points has span, and all columns of key, start and span are longs; events has t (whole seconds) and value, a double that is not null.  A point goes to the block of its start, one longer than the span, and an event to the two
    blocks whose windows can hold it: the windows are ranges of one task's arrays, and a point travels once."""
    columns = points.columns
    points = points.withColumn("__start", start)
    whole = reduce(and_, (F.col(c).isNotNull() for c in (*key, "__start", "span")))
    asks = points.where(whole).withColumn("__block", F.floor(F.col("__start") / (F.col("span") + 1)))
    own = F.floor(F.col("t") / (F.col("span") + 1))
    # Names of their own, since the spans are of the points.
    spans = points.select(*(F.col(c).alias(f"r_{c}") for c in (*key, "span"))).distinct().toDF(*key, "span")
    rows = events.where("t is not null").select(*key, "t", F.col(value).cast("double").alias("__v")).join(F.broadcast(spans), key)
    rows = rows.select(*key, "span", F.col("t").alias("__at"), "__v", F.explode(F.array(own - 1, own)).alias("__block"))
    spark = points.sparkSession
    # Rows are narrow and many: the tasks are not merged for being small.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    groups = [*key, "span", "__block"]
    a, b = (x.repartition(tasks, *groups).groupBy(*groups) for x in (asks, rows))
    kinds = {**dict(points.dtypes), "most": "double", "first": "bigint"}
    found = a.cogroup(b).applyInArrow(_judged, ", ".join(f"`{c}` {kinds[c]}" for c in (*columns, "most", "first")))
    rest = points.where(~whole).select(*columns, F.lit(None).cast("double").alias("most"), F.lit(None).cast("long").alias("first"))
    return found.unionByName(rest)


def extrema_ahead(points: DataFrame, events: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each row of points (id, start, span) for whose key an event has t in [start, start + span]: its id, ``most`` of value and ``first``, the least t."""
    return windows_ahead(points.select(*key, "id", "start", "span"), events, key, F.col("start"), value).where("first is not null").select("id", "most", "first")
