"""Connected components of links, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """v, label (the least vertex of its component) for every vertex of links (a, b).

    Each round takes the least label among the neighbours and then follows labels
    one step, so long chains shrink fast. Sums over a hub's links are partial
    before they are shuffled; a hub's rows in the joins are left to the engine's
    skew splitting. Rounds are cut by written tables: their sizes are known, where
    a checkpoint keeps the estimate of its plan, which grows with every join.
    """
    links = materialised(links.select("a", "b").filter("a <> b").distinct())
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialised(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        ahead = lower.select(F.col("v").alias("p"), F.col("label").alias("pl"))
        new = materialised(lower.join(ahead, F.col("label") == F.col("p")).select("v", "was", F.col("pl").alias("label")))
        labels = new.select("v", "label")
        if new.filter("was <> label").isEmpty():
            return labels
    raise RuntimeError(f"components: labels still change after {rounds} rounds")


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of all links together, from labels of those before and further links: only components that the new links join are labelled anew."""
    ends = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    labels = materialised(labels.unionByName(ends.join(labels, "v", "left_anti").select("v", F.col("v").alias("label"))))
    name = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"{c}_label"))
    joined = links.join(name("a"), "a").join(name("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    merged = components(joined).select(F.col("v").alias("label"), F.col("label").alias("least"))
    return materialised(labels.join(merged, "label", "left").select("v", F.coalesce("least", "label").alias("label")))
