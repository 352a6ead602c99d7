"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, save


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node, label), a row for each node of an edge, label the smallest node reachable.

    In a round each node takes the smallest label of its neighbours and hands it on to the node that was its label
    so far, so that whole trees of labels join; then each takes its label's own label. Components of any shape
    need a number of rounds of about the logarithm of their size. Each round is written to the shared folder; Spark
    reads it with known sizes, so it may broadcast small tables and split nodes with many edges.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a"))
    both = save(both.distinct(), "edges")
    if both.isEmpty():
        none = both.selectExpr("a as node", "b as label")
        none.saved_path = both.saved_path
        return none
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        found = near.join(labels, "node")
        own = found.select("node", F.col("label").alias("old"), F.least("near", "label").alias("label"))
        handed = found.where("near < label").select(F.col("label").alias("node"), F.lit(None).cast("long").alias("old"), F.col("near").alias("label"))
        stepped = save(own.unionByName(handed).groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("label")), "labels")
        jumped = stepped.join(stepped.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        new = save(jumped.select("node", "old", F.col("further").alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        drop(stepped)
        drop(labels)
        labels = new.select("node", "label")
        labels.saved_path = new.saved_path
        if not changed:
            drop(both)
            return labels
