"""Connected components of an edge table, without leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.storage import drop, few, written



def components(edges: DataFrame, nodes: int) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``edges(a, b)``.

    Each round takes the least label among a node and its neighbours, then
    jumps to that label's own label, so labels move twice as far each round.
    A round is written to the shared folder; rounds grow with the logarithm of
    the longest chain.  Hub nodes are summed before the shuffle (a minimum).
    No edges give no rows.  ``nodes`` bounds how many nodes there are and sizes the tables.
    """
    tasks = few(nodes)
    ends = edges.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*").distinct()
    both = written(ends, "edges", tasks)
    labels = written(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")), "labels", tasks)
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        least = labels.join(near, "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("j"))
        new = written(least.join(jump, "c", "left").select("node", F.least("c", F.coalesce("j", "c")).alias("component"), "old"), "labels", tasks)
        moved = new.where("component <> old").limit(1).count()
        drop(labels)
        labels = new
        if not moved:
            drop(both)
            return labels.select("node", "component")
