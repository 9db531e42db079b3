"""Connected components by spreading smallest labels, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from disputeflow.llm.frames import staged


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)``; the label is the smallest node.

    Each round takes the smallest label among a node's neighbours, then the label of that
    label. Labels are written to the shared folder after each round, so that an executor lost
    later costs one round at most. Smallest labels are combined before the shuffle, so a
    node with very many links makes no large group. No links give no rows.
    """
    both = staged(
        links.where("a <> b").select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct(),
        "links",
    )
    labels = staged(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("label")
        ),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = staged(
            lower.join(roots, "label").select("node", "old", F.least("label", "root").alias("label")),
            "labels",
        )
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels
