"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over (u, v) with u > v; returns distinct edges of the same form."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is not its own least keeps its edge to that least
        out = out.unionAll(least.where("u > m").select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(least.where("u > m").select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in the edge table (a, b); root is the least node reachable.

    Self-loops and repeated edges are ignored; an empty table gives an empty result.
    A node that holds a third of all edges stays a join key whose side Spark can split;
    its neighbours are never gathered in one row.
    """
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        nxt = scratch.save(_star(_star(now, True), False), "star")
        # both tables hold distinct edges: the same ones if as many and none is new
        same = nxt.count() == now.count() and nxt.join(now, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(now)
        now = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    # settled: every edge runs from a node to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
