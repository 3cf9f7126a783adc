"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the smallest node of its component.

    Every round takes the smallest label among a node's neighbours (combined
    map-side, so a hub costs one row per task) and then the label of that label.
    Each round is written, so joins read plain tables, hot nodes can be split
    by the adaptive plan and a lost executor repeats one round at most.
    """
    both = materialise(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = materialise(near.select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        low = materialise(labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "lowered")
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = materialise(low.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels
