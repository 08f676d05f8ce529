"""Connected components of a link table."""

from pyspark.sql import DataFrame, functions as F


def components(links: DataFrame, scratch, rounds: int = 64) -> DataFrame:
    """(node, label) for every node of ``links`` (columns ``a``, ``b``); the label is the least node.

    Every round takes the least label among a node and its neighbours and then follows labels of labels,
    so a chain shrinks by doubling and a star is done in two rounds. Each round is settled; the sums of
    labels tell when nothing moved. More than ``rounds`` rounds raise an error.
    """
    both = scratch.settle(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct())
    labels = scratch.settle(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(rounds):
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        offered = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(
            F.min("near").alias("offer"))
        lower = labels.join(offered, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = scratch.settle(lower.join(jump, "label", "left").select(
            "node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"))
        labels = moved.select("node", "label")
        if moved.filter(F.col("label") != F.col("old")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
