"""Connected components of a distributed graph, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: nodes are connected if their roots are equal,
    and the root is the smallest node.

    Randomised contraction: in each round every node joins the neighbour (or itself) with the
    smallest hash under the round's seed, and edges are drawn between what has joined. The expected
    number of edges falls by a constant factor a round, whatever the shape, so rounds grow as the
    logarithm of the graph. A hub's edges are folded by partial minima before the shuffle, and its
    join rows are split by Spark. Every round is a written table; nothing is collected but counts.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = scratch.write(edges, "edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    found = scratch.write(ends.select("node", F.col("node").alias("rep")), "nodes")
    round_ = 0
    while not edges.isEmpty():
        round_ += 1
        rank = F.struct(F.xxhash64(F.lit(round_), "w").alias("h"), F.col("w"))
        arcs = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        least = arcs.groupBy("v").agg(F.min(rank).alias("least"))
        own = F.struct(F.xxhash64(F.lit(round_), "v").alias("h"), F.col("v").alias("w"))
        step = scratch.write(least.select("v", F.least(F.col("least"), own)["w"].alias("to")), "step")
        rest = edges.join(step.select(F.col("v").alias("a"), F.col("to").alias("a2")), "a")
        rest = rest.join(step.select(F.col("v").alias("b"), F.col("to").alias("b2")), "b").filter("a2 <> b2")
        smaller = scratch.write(rest.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        moved = found.join(step.select(F.col("v").alias("rep"), "to"), "rep", "left")
        relabelled = scratch.write(moved.select("node", F.coalesce("to", "rep").alias("rep")), "nodes")
        scratch.drop(edges, step, found)
        edges, found = smaller, relabelled
    scratch.drop(edges)
    roots = found.groupBy("rep").agg(F.min("node").alias("root"))
    return found.join(roots, "rep").select("node", "root")
