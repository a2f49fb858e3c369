"""Connected components of an edge table, by alternating stars. No part of it leaves the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.shared import settled


def _distinct(a: Column, b: Column, df: DataFrame) -> DataFrame:
    return df.select(a.alias("a"), b.alias("b")).filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return _distinct(F.col("b"), F.col("least"), both.filter("b > a").join(least, "a"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _distinct(F.col("a"), F.col("b"), linked.unionByName(least.select("a", F.col("least").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: non-null longs, any direction, repeats and loops allowed).

    root is the least node reachable. Each round makes the nodes' links shorter and is kept in the shared folder;
    the rounds end when the links no longer change, after about the logarithm of the longest chain."""
    edges = settled(_distinct(F.col("a"), F.col("b"), edges))
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state, edges = now, settled(_small_star(_large_star(edges)))
