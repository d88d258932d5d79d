"""Graph algorithms on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut, drop


def connected_components(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected graph; the component is its smallest node.

    Each round takes the smallest label among the neighbours, then the label of that label, so that the rounds grow
    with the logarithm of the longest path. Edges with a missing end are ignored. Nodes with very many edges are no
    bottleneck: joins shuffle both sides, so that skewed partitions are split, and minima are taken map-side first.
    """
    one = edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).dropna()
    both = cut(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src").agg(F.min("label").alias("low"))
        near = near.select(F.col("src").alias("node"), "low")
        lower = cut(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label")))
        hop = lower.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut(lower.join(hop, "label").select("node", F.col("far").alias("label"), (F.col("far") != F.col("old")).alias("moved")))
        drop(labels, lower)
        labels = new
        if new.filter("moved").isEmpty():
            drop(both)
            return new.select("node", F.col("label").alias("component"))
