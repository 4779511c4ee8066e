"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.common import materialize, spent


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, root (longs): nodes are linked by the columns a and b of edges; nodes without an edge don't occur.

    Each round every node joins the neighbour (or itself) of the lowest hash, and edges are contracted. With fresh hashes each
    round the number of nodes falls by a constant factor at least, whatever the graph's shape, so it ends. A node with very many edges costs a
    partial aggregation and a join that may be split. Nothing but the emptiness of the edge list reaches the driver. Each round writes its
    edges with both ends' parents once; labels are the chain of these. files: how many a round writes at most."""
    left = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    left = first = materialize(left, "edges", files)
    labels, steps = None, []
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), c.alias("u"))  # noqa: E731, B023
        both = left.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        parent = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("best")).select("u", F.least("best", rank(F.col("u")))["u"].alias("p"))
        step = left.join(parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        step = materialize(step.select("a", "b", "pa", "pb"), "step", files)
        steps.append(step)
        moved = step.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("pa").alias("p")), F.struct(F.col("b").alias("u"), F.col("pb").alias("p"))))).distinct()
        if labels is None:
            labels = moved.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = labels.join(moved, labels.root == moved.u, "left").select("node", F.coalesce("p", "root").alias("root"))
        left = step.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct()
    if labels is None:
        return first.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = materialize(labels, "labels", files)
    spent(first, *steps)
    return labels
