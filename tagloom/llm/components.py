"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import staged


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` of every node in ``edges`` (a, b); the label is a component's smallest node.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so a chain halves its length each time.  Rounds are
    written to the shared folder; the minimum is partial before each shuffle and
    each label is one row, so a large component is split like any other key.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        lower = staged(lower, "lower")
        top = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = lower.join(top, "label").select("node", F.col("top").alias("label"), "before")
        labels = staged(jumped, "labels")
        if labels.where("label <> before").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
