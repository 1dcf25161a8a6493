"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import spread_join, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a long, b long) and the smallest node it can reach.

    Every round gives a node the smallest label among its neighbours and then
    the label of that label (pointer jumping), so the number of rounds grows
    with the logarithm of the longest path.  Each round's labels are written to
    shared storage.  A hub's edges are reduced before the shuffle (partial
    ``min``); labels that many nodes share are looked up by a bounded broadcast.
    Null ends are dropped; an empty edge table gives an empty result.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("near_node")).agg(F.min("root").alias("low")))
        step = labels.join(near, labels.node == near.near_node).select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        step = stored(step, "step")
        # a large component's nodes share their label: count how many look each label up
        met = step.groupBy(F.col("root").alias("met")).agg(F.count("*").alias("lookups"))
        ahead = stored(labels.join(met, labels.node == met.met).select(F.col("node").alias("next_node"), F.col("root").alias("next_root"), "lookups"), "ahead")
        moved = spread_join(step, "root", ahead, "next_node", "lookups").select("node", "was", F.least("root", "next_root").alias("root"))
        moved = stored(moved, "labels")
        if moved.where("was <> root").isEmpty():
            return moved.select("node", "root")
        labels = moved.select("node", "root")
