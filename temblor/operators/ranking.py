"""Scores against labels, and exact samples by hash, from counts by ranges of the score or the hash: no task sees all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_score(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """keys, score, c and y: rows and positives with this score."""
    return df.groupBy(*keys, score).agg(F.count("*").alias("c"), F.sum(F.col(label).cast("long")).alias("y"))


def thresholds(df: DataFrame, keys: list[str], score: str, label: str, part: Column) -> DataFrame:
    """``ranked_scores`` of ``by_score``."""
    return ranked_scores(by_score(df, keys, score, label), keys, score, part)


def ranked_scores(by: DataFrame, keys: list[str], score: str, part: Column) -> DataFrame:
    """keys, score, c and y (rows and positives with this score), c_above and y_above (with a greater one), n and pos (of the key), of ``by_score``, which is read twice.

    ``part`` is a column of the score that rises with it: parts are summed, and only scores of one part are put in order."""
    by = by.withColumn("__part", part)
    parts = by.groupBy(*keys, "__part").agg(F.sum("c").alias("pc"), F.sum("y").alias("py"))
    whole, down = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = parts.select(*keys, "__part", zero(F.sum("pc").over(down)).alias("c0"), zero(F.sum("py").over(down)).alias("y0"), F.sum("pc").over(whole).alias("n"), F.sum("py").over(whole).alias("pos"))
    within = Window.partitionBy(*keys, "__part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({"ci": zero(F.sum("c").over(within)), "yi": zero(F.sum("y").over(within))}).join(parts, [*keys, "__part"])
    return by.select(*keys, score, "c", "y", (F.col("c0") + F.col("ci")).alias("c_above"), (F.col("y0") + F.col("yi")).alias("y_above"), "n", "pos")


def quality(t: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, pos, auc, ap (average precision) and f1 (the best over all thresholds) of ``thresholds``; null without both labels."""
    c = F.col
    both = (c("pos") > 0) & (c("pos") < c("n"))
    # A positive beats the negatives below it, and half of those beside it.
    below = (c("n") - c("pos")) - (c("c_above") - c("y_above")) - (c("c") - c("y"))
    wins = c("y") * (below + (c("c") - c("y")) / 2)
    taken, hits = c("c_above") + c("c"), c("y_above") + c("y")
    g = t.withColumns({"wins": wins, "gain": c("y") * hits / taken, "f": 2 * hits / (taken + c("pos")), "both": both}).groupBy(*keys)
    a = g.agg(F.first("n").alias("n"), F.first("pos").alias("pos"), F.first("both").alias("both"), F.sum("wins").alias("wins"), F.sum("gain").alias("gain"), F.max("f").alias("f"))
    when = lambda x: F.when(c("both"), x)
    return a.select(*keys, "n", "pos", when(c("wins") / (c("pos") * (c("n") - c("pos")))).alias("auc"), when(c("gain") / c("pos")).alias("ap"), when(c("f")).alias("f1"))


def hash_order(salt: Column, *of: Column) -> Column:
    """A text whose order is a fixed shuffle, the same in any engine."""
    return F.md5(F.concat_ws(":", salt, *(c.cast("string") for c in of)).cast("binary"))


def first_by_hash(df: DataFrame, key: list[str], order: str, wanted: Column) -> DataFrame:
    """The rows of each key that come first by ``order`` (a text of ``hash_order``), as many as ``wanted`` (a column that is the same for all rows of a key) says.

    Counts by the first digits of the hash tell in which part the last of them lies; only that part's rows are ranked."""
    df = df.withColumns({"__wanted": wanted, "__part": F.substring(order, 1, 3)})
    parts = df.groupBy(*key, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.join(parts.select(*key, "__part", "__n", before.alias("__before")), [*key, "__part"]).where("__before < __wanted")
    whole = df.where("__before + __n <= __wanted")
    edge = df.where("__before + __n > __wanted").withColumn("__k", F.row_number().over(Window.partitionBy(*key, "__part").orderBy(order)))
    drop = ["__wanted", "__part", "__n", "__before"]
    return whole.drop(*drop).unionByName(edge.where("__before + __k <= __wanted").drop("__k", *drop))


def uniform(salt: Column, *of: Column) -> Column:
    """A number from 0 up to 1 from the first eight digits of ``hash_order``."""
    return F.conv(F.substring(hash_order(salt, *of), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson(u: Column, rate: Column, most: int = 12) -> Column:
    """A Poisson number of the rate from a uniform one: how many of the cumulative chances are at or below it.  ``most`` bounds it; rates are at most 2, where more has a chance below 1e-6."""
    chance = total = F.exp(-rate)
    out = (u >= total).cast("int")
    for k in range(1, most):
        chance = chance * rate / k
        total = total + chance
        out = out + (u >= total).cast("int")
    return out
