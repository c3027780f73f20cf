"""Connected components of an edge table by repeated minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the component's smallest node.

    Every round takes each node's smallest neighbouring label (combined map-side, so hubs
    cost one row per task) and then the label of that label. Labels are written to the
    shared folder between rounds. Ends when a round changes nothing.
    """
    one = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct()
    both = stored(one.union(one.select("y", "x")), "edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("root")), "labels")
    for _ in range(rounds):
        near = (
            both.join(labels, both["y"] == labels["node"])
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        lower = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("root").alias("jump"))
        moved = stored(
            lower.join(up, "low", "left").select("node", F.col("root").alias("old"), F.least("low", F.coalesce("jump", "low")).alias("root")),
            "labels",
        )
        changed = moved.where("root <> old").limit(1).count()
        labels = moved.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("components did not settle; raise the number of rounds")
