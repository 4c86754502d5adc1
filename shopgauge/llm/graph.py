"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgauge.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """node, root for every end of a link (columns a, b): root is the smallest node of its component.

    Every round takes the smallest label among a node and its neighbours and then the label's own label, so paths
    shrink by more than half; each round is a stored table of one row per node. Hubs are left to Spark's splitting.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        up = step.select(F.col("node").alias("parent"), F.col("root").alias("grand"))
        labels = stored(step.join(up, F.col("root") == F.col("parent")).select("node", F.least("root", "grand").alias("root"), "old"))
        if labels.where("root <> old").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
