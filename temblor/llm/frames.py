"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words, everywhere in this subpackage.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) has this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:  # one machine, as in tests, has its own folder; a cluster shares its warehouse
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        base = "file:///tmp/temblor-shared" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/temblor-shared"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """``fn`` over Arrow batches, one at a time; ``done`` ends a task, so that a worker keeps nothing large for the tasks of other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    out = fn(batch)
                    if out is not None and out.num_rows:
                        yield out
        finally:
            if done:
                done()

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Two longs that stand for a row: repeated rows share them, different texts under one id do not.  Ids of any type are told apart."""
    number = F.coalesce(doc_id.cast("string").try_cast("long"), F.xxhash64(doc_id.cast("string")))
    return [F.when(doc_id.isNull(), F.lit(-(2**63))).otherwise(number).alias("k1"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("k2")]


def bounded_sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """The rows with the ``max_rows`` smallest values of their column ``h``, a hash; ties of the last value all stay.

    Counts of the hash's first 16 bits tell in which of 65,536 parts the last of them lies; only that part's hashes are sorted."""
    part = F.shiftright("h", 48)
    so_far = 0
    for p, n in sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect()):
        if so_far + n >= max_rows:
            last = rows.where(part == p).select("h").orderBy("h").limit(max_rows - so_far).agg(F.max("h")).first()[0]
            return rows.where(F.col("h") <= F.lit(last))
        so_far += n
    return rows
