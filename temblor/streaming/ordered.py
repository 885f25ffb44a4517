"""Rows of a stream judged in order of their time, whatever order and batch they come in.

The state of a key has the rows that the watermark has not passed, and what a fold keeps.  A timer stands at the earliest of the rows; once the
watermark passes, the rows it has passed go through the fold in order.  Rows at or before the watermark are late and left out, so that a repeated row is either beside its
first in the state, where both are one, or late.

Rows travel and wait as Arrow batches: a task packs its rows by key before they are shuffled, since a row by itself costs far more than its bytes on its way through a Python worker and the state store."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.graph import shared_dir

#: (rows in order, what is kept, the end of time so far) to (results, what is kept then, the next time at which something may happen by itself).
Fold = Callable[[list[tuple], list[tuple], float], tuple[list[tuple], list[tuple], float | None]]
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
PANDAS = {"int": "Int32", "long": "Int64", "double": "Float64", "string": "object"}
#: Rows that a task packs in one go, and of an Arrow batch in the state.
AT_ONCE, BATCH = 200_000, 50_000


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], ARROW[c.split()[1]]) for c in schema.split(", ")])


def milliseconds(t: float) -> int:
    return math.floor(t * 1000)


def packs(table: pa.Table) -> list[bytes]:
    return [b.serialize().to_pybytes() for b in table.combine_chunks().to_batches(max_chunksize=BATCH)]


def unpacked(blobs, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(b, schema) for b in blobs], schema=schema)


def tuples(table: pa.Table) -> list[tuple]:
    """Rows, with None for NaN too."""
    columns = [pc.if_else(pc.is_nan(c), None, c) if pa.types.is_floating(c.type) else c for c in table.columns]
    return list(zip(*(c.to_pylist() for c in columns), strict=True))


def packer(key: str, schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches with key, time and the columns of the schema: the key, its last time and its rows as Arrow batches."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows, [(key, "ascending")])).combine_chunks()
        keys = rows[key].chunk(0)
        starts = np.append(0, 1 + np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)))
        last = np.maximum.reduceat(rows["time"].cast(pa.int64()).to_numpy(), starts)
        content = rows.select(names(schema)).cast(arrow(schema)).to_batches()[0]
        blobs = [content.slice(a, b - a).serialize().to_pybytes() for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True)]
        return pa.record_batch([keys.take(pa.array(starts)), pa.array(last).cast(rows["time"].type), pa.array(blobs, pa.binary())], names=[key, "time", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= AT_ONCE:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return pack


class InOrder(StatefulProcessor):
    """``waiting``, ``kept`` and ``out`` are schemas; ``waiting`` has t, in seconds, and rows are folded in order of t and then of its other columns; ``out`` begins with the key."""

    def __init__(self, waiting: str, kept: str, out: str, fold: Fold):
        self.schema, self.kept_schema, self.out, self.fold = waiting, kept, out, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getListState("kept", "rows binary")

    def held(self, state, schema: str) -> pa.Table:
        return unpacked([r[0] for r in state.get()] if state.exists() else [], arrow(schema))

    @staticmethod
    def times(rows: pa.Table) -> np.ndarray:
        """In milliseconds."""
        return np.floor(rows["t"].to_numpy() * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        passed, first = timerValues.getCurrentWatermarkInMs(), math.inf
        for frame in rows:
            fresh = unpacked(frame["rows"], arrow(self.schema))
            fresh = fresh.filter(pa.array(self.times(fresh) > passed))
            if fresh.num_rows:
                self.waiting.appendList([(b,) for b in packs(fresh)])
                first = min(first, self.times(fresh).min())
        if first < math.inf:
            self.handle.registerTimer(int(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs()
        rows = self.held(self.waiting, self.schema)
        on = self.times(rows) <= passed
        others = [n for n in names(self.schema) if n != "t"]
        due = rows.filter(pa.array(on)).group_by(names(self.schema)).aggregate([]).select(names(self.schema)).sort_by([(n, "ascending") for n in ["t", *others]])
        later = rows.filter(pa.array(~on))
        found, kept, wake = self.fold(tuples(due), tuples(self.held(self.kept, self.kept_schema)), passed / 1000)
        columns = [pa.array(c, kind) for c, kind in zip(zip(*kept, strict=True), arrow(self.kept_schema).types, strict=True)] if kept else []
        for state, content in ((self.waiting, packs(later)), (self.kept, packs(pa.table(columns, schema=arrow(self.kept_schema))) if kept else [])):
            state.put([(b,) for b in content]) if content else state.clear()
        ahead = ([int(self.times(later).min())] if later.num_rows else []) + ([milliseconds(wake) + 1] if wake is not None else [])
        if ahead:
            self.handle.registerTimer(min(ahead))
        if found:
            columns = [c.split() for c in self.out.split(", ")]
            yield pd.DataFrame([(key[0], *f) for f in found], columns=[n for n, _ in columns]).astype({n: PANDAS[kind] for n, kind in columns})

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, processor: InOrder, delay: int) -> DataFrame:
    """The processor's results over a stream (key, t, and others); rows without key or t are left out."""
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.where(F.col(key).isNotNull() & F.col("t").isNotNull()).select(F.col(key).alias("key"), F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("time"), *(F.col(c.split()[0]).cast(c.split()[1]) for c in processor.schema.split(", ")))
    rows = rows.mapInArrow(packer("key", processor.schema), f"key {kind}, time timestamp, rows binary").withWatermark("time", f"{delay} seconds")
    return rows.groupBy("key").transformWithStateInPandas(processor, processor.out, "append", "EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for the queries started inside."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def delivered(spark: SparkSession, batches: list[DataFrame], schema: str, run, label: str) -> DataFrame:
    """What ``run`` makes of a stream that gets ``batches`` one after the other; each starts the query again from its checkpoint."""
    source, sink = shared_dir(spark, f"{label}-in"), shared_dir(spark, label)
    with rocks(spark):
        for batch in batches:
            batch.write.mode("append").parquet(source)
            out = run(spark.readStream.schema(schema).parquet(source))
            out.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
