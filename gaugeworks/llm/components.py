"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeworks.llm.base import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node reachable.

    Each round takes the least root among a node's neighbours and then the root
    of that root, so that the number of rounds grows with the logarithm of the
    longest chain.  A round is written to the shared folder: its lineage ends
    there.  A node with very many neighbours is combined before the shuffle,
    and the joins have no window above them, so that skewed ones are split.
    """
    both = staged(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a <> b").distinct(), "links")
    roots = staged(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
        .withColumn("moved", F.lit(True)), "roots")
    while not roots.filter("moved").isEmpty():
        held = roots.select("node", "root")
        near = (both.join(held.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        lower = held.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("step"))
        up = held.select(F.col("node").alias("step"), F.col("root").alias("above"))
        roots = staged(
            lower.join(up, "step").select(
                "node", F.least("step", "above").alias("root"),
                (F.least("step", "above") < F.col("old")).alias("moved")), "roots")
    return roots.select("node", "root")
