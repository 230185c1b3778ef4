"""Connected components of a table of pairs, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage_table


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node in ``edges`` (a, b: bigint).

    Each round a node takes the smallest label among its own, its neighbours' and that
    of its label; rounds end when nothing changes. Every round is a written table."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = stage_table(both, "cc-edges")
    labels = stage_table(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")).withColumn("was", F.col("node")), "cc"
    )
    while labels.where("root <> was").limit(1).count():
        here = labels.select(F.col("node").alias("b"), F.col("root").alias("near"))
        near = both.join(here, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        own = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        labels = stage_table(
            labels.select("node", "root").join(near, "node").join(own, "root").select(
                "node", F.least("root", "near", "beyond").alias("root"), F.col("root").alias("was")
            ),
            "cc",
        )
    return labels.select("node", "root")
