"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.runtime import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Each round a node takes the smallest label among its neighbours and then the label of that
    label, so chains shrink by a constant factor per round.  Minima are combined before the
    shuffle, so a node with very many neighbours is no hot key.  Labels live in the shared
    folder between rounds; nothing but a row count per round reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a <> b").distinct(), "cc-edges")
    lowest = both.groupBy("a").agg(F.min("b").alias("_low"))
    labels = materialize(lowest.select(F.col("a").alias("node"), F.least("a", "_low").alias("label")), "cc-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_near"))
        hooked = labels.join(near, F.col("node") == F.col("a")).select(
            "node", "label", F.least("label", "_near").alias("_new"))
        hooked = materialize(hooked, "cc-hooked")
        # The old label learns the new one too, so whole trees move at once.
        pulled = hooked.filter("_new < label").groupBy("label").agg(F.min("_new").alias("_pulled")).select(
            F.col("label").alias("_of"), "_pulled")
        moved = hooked.join(pulled, F.col("node") == F.col("_of"), "left").select(
            "node", F.col("label").alias("_old"), F.least("_new", F.coalesce("_pulled", "_new")).alias("label"))
        moved = materialize(moved, "cc-moved")
        up = moved.select(F.col("node").alias("_of"), F.col("label").alias("_up"))
        jumped = materialize(moved.join(up, F.col("label") == F.col("_of"), "left").select(
            "node", "_old", F.least("label", F.coalesce("_up", "label")).alias("label")), "cc-jumped")
        if jumped.filter("label <> _old").isEmpty():
            return labels.withColumnRenamed("label", "component")
        labels = jumped.select("node", "label")
