"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (least node of its component) for every node of ``edges`` (``a``, ``b``).

    Each round takes the least label around a node and then the label of that label; the labels of a round
    are written to the shared folder, so a lost executor never repeats earlier rounds.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        nearer = labels.join(around, "node").select("node", F.least("component", "_near").alias("_to"), F.col("component").alias("_old"))
        jump = labels.select(F.col("node").alias("_to"), F.col("component").alias("_next"))
        after = stored(nearer.join(jump, "_to", "left").select("node", F.least("_to", F.coalesce("_next", "_to")).alias("component"), "_old"), "labels")
        labels = after.select("node", "component")
        if after.filter("component <> _old").isEmpty():
            return labels
