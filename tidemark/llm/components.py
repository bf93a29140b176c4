"""Connected components by least labels, with pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """node, comp (the least node reachable) for all nodes of edges (a, b)."""
    both = scratch.stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("onward"))
        step = step.join(jump, "to").select("node", F.col("comp").alias("was"), F.least("to", "onward").alias("comp"))
        new = scratch.stage(step, "labels")
        scratch.drop(labels)
        changed = new.where("was <> comp").limit(1).count()
        labels = new.select("node", "comp")
        labels._staged_at = new._staged_at
        if not changed:
            scratch.drop(both)
            return labels
