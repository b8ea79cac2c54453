"""Connected components of an edge table, by contraction, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.spark import few_files, release, stash


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b): component is the least node reachable.

    Each round every node points to its least neighbour (or itself), pointers
    are followed twice, and the edges are drawn anew between the nodes pointed
    at; the number of nodes that still have edges falls by a factor each round.
    The tables stay on the executors; rounds are written to the shared folder.
    """
    edges = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label, n = None, edges.count()
    nodes = 2 * n
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        for _ in range(2):
            point = point.alias("p").join(point.select(F.col("node").alias("n2"), F.col("to").alias("t2")), F.col("to") == F.col("n2"), "left").select("node", F.coalesce("t2", "to").alias("to"))
        point = stash(few_files(point, 2 * n), "point")
        if label is None:
            new = point.select("node", F.col("to").alias("component"))
        else:
            new = label.join(point.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        new = stash(few_files(new, nodes), "label")
        a, b = (point.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        drawn = edges.join(a, "a").join(b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct()
        drawn = stash(few_files(drawn, n), "edges")
        release(edges, point, *([label] if label is not None else []))
        edges, label, n = drawn, new, drawn.count()
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label
