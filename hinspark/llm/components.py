"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is two grouped minima and two joins over the edges; the edges are
written to the shared folder after each round, and only their count and a
checksum reach the driver.  The number of rounds grows with the logarithm of the
largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v, each once. Points neighbours of each node to the smallest one."""
    if large:  # all neighbours of u; those above u move
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its neighbours below it
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node.

    Null ends and self-loops are no edges.
    """
    now = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, seen = written(now, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        last, seen = now, mark
        now = written(_star(_star(now, True), False), "edges")
        dropped(last)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
