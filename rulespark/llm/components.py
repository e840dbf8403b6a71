"""Connected components by label propagation with shortcuts, each round written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the least node reachable) for the nodes of ``edges`` (``a``, ``b``).

    In each round a node takes the least label among itself and its neighbours, and then its label's label; so the number of rounds
    grows with the logarithm of the longest path where labels follow it. No edges give no rows; repeated edges and loops do no harm.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = labels.select(F.col("node").alias("near"), F.col("component").alias("c"))
        offers = both.join(near, "near").groupBy("node").agg(F.min("c").alias("c"))
        step = labels.join(offers, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        new = stored(step.join(up, "component", "left").select("node", "old", F.least("component", F.coalesce("higher", "component")).alias("component")), "labels")
        changed = new.filter("old <> component").limit(1).count()
        forget(labels)
        labels = new.select("node", "component")
        if not changed:
            forget(both)
            return labels
