"""Connected components by smallest label, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node that can be reached.

    A round takes the smallest label among a node's neighbours, then follows that label once
    (pointer jumping), so long chains shorten by half each round. Each round is written to the shared
    folder; only the number of changed rows comes to the driver.
    """
    both = materialise(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    label = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "label")
    for _ in range(most_rounds):
        near = both.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = label.join(near, label.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        ahead = label.select(F.col("node").alias("component"), F.col("component").alias("ahead"))
        new = materialise(step.join(ahead, "component").select("node", "old", F.least("component", "ahead").alias("component")), "round")
        changed = new.where("old <> component").limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
