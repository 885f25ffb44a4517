"""Connected components of pairs of events, as DataFrame joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or the warehouse of a cluster that has none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        one_machine = master.startswith("local") and not master.startswith("local-cluster")
        base = "file:///tmp/temblor-shared" if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/temblor-shared"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the folder that the cluster shares."""
    path = shared_dir(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): each round takes the smallest label next to a node and the label of that label, until none changes."""
    edges = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("other"))
        best = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "other").alias("label"), F.col("label").alias("was"))
        jump = best.alias("x").join(best.alias("y"), F.col("x.label") == F.col("y.node"))
        after = checkpointed(jump.select(F.col("x.node").alias("node"), F.least("x.label", "y.label").alias("label"), F.col("x.was").alias("was")))
        if after.where("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
