"""Places and earlier values of rows in the order of a key, without a task for each key.

A key's rows are dealt out by blocks, values that rise with the order (days of a time, ranges of a number).  What a row needs
of the blocks before its own comes from a table of one row a key and block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blocked(df: DataFrame, key: list[str], block: Column, of_block: dict[str, Column], running: dict[str, Column]) -> DataFrame:
    """df with __block, and what the blocks before have in ``running``: aggregates ``of_block`` of each block, then functions of them over the blocks before."""
    # Structs are never null, so that null keys meet in the join.
    df = df.withColumns({"__key": F.struct(*key), "__block": block})
    blocks = df.groupBy("__key", "__block").agg(*(c.alias(n) for n, c in of_block.items()))
    before = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(blocks.select("__key", "__block", *(c.over(before).alias(n) for n, c in running.items())), ["__key", "__block"])


def numbered(df: DataFrame, key: list[str], order: list, block: Column, name: str = "k") -> DataFrame:
    """df with each row's place, from 0, among the rows of its key."""
    df = _blocked(df, key, block, {"__n": F.count("*")}, {"__before": F.sum("__n")})
    own = F.row_number().over(Window.partitionBy("__key", "__block").orderBy(*order)) - 1
    return df.withColumn(name, F.coalesce("__before", F.lit(0)) + own).drop("__key", "__block", "__before")


def carried(df: DataFrame, key: list[str], order: list[str], value: str, block: Column, name: str, own: bool = True) -> DataFrame:
    """df with the last value that is not null of the rows of the key up to each row, itself included if ``own``."""
    df = _blocked(df, key, block, {"__last": F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("__v"))))}, {"__before": F.last("__last", ignorenulls=True)})
    w = Window.partitionBy("__key", "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.col("__before.__v"))).drop("__key", "__block", "__before")
