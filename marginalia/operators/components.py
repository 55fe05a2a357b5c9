"""Connected components by hooking and shortcutting; labels and edges stay distributed."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import materialize, materialize_with, release


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, component`` where the component is its smallest node.

    ``nodes(node)``, ``edges(a, b)``; edges count in both directions, repeats and self-loops are harmless, edges to
    unknown nodes and null ends are dropped. Each round hooks every root to the smallest grandparent seen across an
    edge, hooks every node likewise, and halves the paths: the number of rounds grows with the logarithm of the
    longest chain. All updates are minima, combined before they shuffle, so a hub of any size stays cheap.
    """
    nodes = nodes.where("node is not null").distinct()
    plain = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    known = both.join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi")
    graph = materialize(known.select("a", "b"), "edges")
    # the first hook needs no join: every node starts as its own parent
    near = graph.groupBy("a").agg(F.min("b").alias("m"))
    start = nodes.join(near, nodes["node"] == near["a"], "left").select("node", F.least("node", F.coalesce("m", "node")).alias("f"))
    labels = materialize(start, "labels")
    for _ in range(max_rounds):
        up = labels.select(F.col("node").alias("p"), F.col("f").alias("g"))
        # kept for this round only; what is lost with an executor is made again from the written labels
        grand = labels.join(up, labels["f"] == up["p"]).select("node", "f", "g").persist(StorageLevel.MEMORY_AND_DISK)
        far = grand.select(F.col("node").alias("b"), F.col("g").alias("gb"))
        own = grand.select(F.col("node").alias("a"), F.col("f").alias("fa"))
        seen = graph.join(far, "b").groupBy("a").agg(F.min("gb").alias("m")).join(own, "a")
        wish = (
            seen.select(F.col("fa").alias("node"), "m")
            .unionByName(seen.select(F.col("a").alias("node"), "m"))
            .unionByName(grand.select("node", F.col("g").alias("m")))
            .groupBy("node")
            .agg(F.min("m").alias("m"))
        )
        step = grand.join(wish, "node", "left").select("node", F.least("f", F.coalesce("m", "f")).alias("f"), (F.coalesce("m", "f") < F.col("f")).alias("moved"))
        step, sums = materialize_with(step, "labels", moved=F.count_if("moved"))
        grand.unpersist()
        release(labels)
        labels = step
        if not sums["moved"]:
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    release(graph)
    return labels.select("node", F.col("f").alias("component"))
