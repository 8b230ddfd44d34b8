"""Connected components by contraction: every node merges into its smallest neighbour until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import remove, save


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    A round maps each node to the smallest of itself and its neighbours and relabels the edges. A chain that is cut this
    way stays linked, as the edge to the neighbour is relabelled with the rest. The edges shrink by at least half in
    a round on all but chosen graphs. Nodes with very many edges are summed before the shuffle and split in joins.
    """
    spark = edges.sparkSession
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    left = save(edges.filter("a <> b").select(lo.alias("a"), hi.alias("b")).distinct(), f"{folder}/edges0")
    labels, turn = None, 0
    while labels is None or left.limit(1).count():
        turn += 1
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        up = save(up.select("node", F.least("node", "to").alias("to")), f"{folder}/up{turn}")
        other = up.select(F.col("node").alias("node2"), F.col("to").alias("to2"))
        moved = left.join(up, F.col("a") == F.col("node")).join(other, F.col("b") == F.col("node2")).filter("to <> to2")
        left = save(moved.select(F.least("to", "to2").alias("a"), F.greatest("to", "to2").alias("b")).distinct(), f"{folder}/edges{turn}")
        remove(spark, f"{folder}/edges{turn - 1}")
        if labels is None:
            labels = up.withColumnRenamed("to", "root")
        else:
            step = up.withColumnRenamed("node", "_n")
            labels = labels.join(step, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = save(labels, f"{folder}/labels{turn}")
    return labels
