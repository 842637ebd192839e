"""Connected components of an edge table, by least labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge; comp is the least node that edges reach. Edges may repeat or be loops.

    Each round takes the least label of a node's neighbours, lets the label's own node have it too, and jumps to the
    label's label, so rounds grow with the logarithm of a component's width. Labels are written between rounds.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = written(both.union(both.select("y", "x")).distinct(), "edges")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        # The node that gave the old label learns the lesser one, which hooks whole trees onto each other.
        hooks = least.where("comp < old").groupBy(F.col("old").alias("node")).agg(F.min("comp").alias("hook"))
        least = least.join(hooks, "node", "left").select("node", "old", F.least("comp", F.coalesce("hook", "comp")).alias("comp"))
        least = written(least, "least")
        jump = least.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        labels = written(least.join(jump, "comp", "left").select("node", "old", F.coalesce("next", "comp").alias("comp")), "labels")
        changed = labels.where("comp <> old").limit(1).count()
        labels = labels.select("node", "comp")
        if not changed:
            return labels
