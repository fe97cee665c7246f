"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.scratch import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is one node of its component.

    Contraction: each node points to its smallest neighbour (or itself),
    pointers are followed to their ends, and the edges between different ends
    form the next, smaller graph. Minima are partial aggregates, and every round
    is written, so a node with a third of all edges and a lost executor are both
    harmless. The number of rounds grows with the logarithm of the nodes.
    """
    left = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    total = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "point")
        while True:  # halve the pointer chains until all point to ends
            up = point.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            jumped = written(point.join(up, point["root"] == up["mid"]).select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "point")
            point = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if total is None:
            total = point
        else:
            ends = point.select(F.col("node").alias("old"), F.col("root").alias("new"))
            total = written(total.join(ends, total["root"] == ends["old"], "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
        pa = point.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        pb = point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = written(left.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    if total is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return total
