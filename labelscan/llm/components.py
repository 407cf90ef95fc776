"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node that can be reached, for every node of a link.

    Each round takes the smallest label among a node and its neighbours, and then that label's own label, so that the
    rounds needed grow with the logarithm of a component's width. Sums are partial, joins can be split at hot nodes,
    and every round is written to the shared folder.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        again = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        jumped = stored(lower.join(again, F.col("component") == F.col("_n"), "left").select("node", "old", F.least("component", F.coalesce("_c", "component")).alias("component")), "labels")
        labels = jumped.select("node", "component")
        if jumped.where(F.col("old") != F.col("component")).isEmpty():
            return labels
