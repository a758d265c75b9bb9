"""Connected components of a table of links, by minimal labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import busy_parts, dealt_join
from timberline.session import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b); the label is the component's smallest node.

    Every round passes labels along all links and then to the label's own label, so that the number
    of rounds grows with the logarithm of the longest path. Nodes with many links are salted. A round is
    few small jobs, as the driver keeps something of each.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = materialize(both.unionAll(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    busy = busy_parts(both, ["node"])
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        passed = dealt_join(both, labels.select("node", "label"), ["node"], ["other"], parts=busy)
        passed = passed.select(F.col("other").alias("node"), "label", F.lit(None).cast("bigint").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        # a node has one old label
        least = passed.unionAll(own).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        least = materialize(least, "least")
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = dealt_join(least, further, ["label"], ["node"]).select("node", F.least("label", "next").alias("label"), "old")
        newer = materialize(jumped, "labels")
        done = newer.where(F.col("label") != F.col("old")).isEmpty()
        discard(labels, least)
        labels = newer
        if done:
            discard(both, busy)
            found = labels.select("node", "label")
            found.written_to = labels.written_to
            return found
