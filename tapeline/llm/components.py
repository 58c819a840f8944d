"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm import common


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of edges (a, b).

    Each round takes the smallest label among a node and its neighbours, then the label of that label, so
    labels travel along doubling distances. Only minima are gathered at a node, however many its edges.
    """
    both = common.stage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = common.stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        hooked = common.stage(hooked, "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = common.stage(hooked.join(up, "label").select("node", "was", F.col("above").alias("label")), "labels")
        if new.where("was <> label").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
