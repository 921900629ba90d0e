"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.storage import cut


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` of every node of ``edges (a, b)``, root the smallest node reachable.

    Labels fall to the least of the neighbours' labels and then to their label's label, until none moves; all state is
    a table written every round."""
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n2")).agg(F.min("root").alias("low"))
        down = labels.join(near, F.col("node") == F.col("n2")).select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        up = down.select(F.col("node").alias("n3"), F.col("root").alias("r3"))
        new = cut(down.join(up, F.col("root") == F.col("n3"), "left").select("node", "old", F.least("root", F.coalesce("r3", "root")).alias("root")))
        moved = new.where("old <> root").limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError("the components did not settle")
