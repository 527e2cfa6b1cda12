"""Connected components of large edge sets, by alternating large and small stars.

Only minima by key, over rows that spill: no node's neighbours are gathered in memory, though the edges of
one node, two numbers each, come to one task. (A join with the minima would spread them; it took three
times the shuffles, more than the check tool's disk over its 211 partitions.) Nothing comes to the driver
but counters. Lineage is cut by a checkpoint a round; rounds go on until nothing changes, about the
logarithm of the longest path.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return r[0], int(r[1])


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node of the edges (u, v), longs; component is the least node reachable.

    With `rounds`, only so many rounds: nodes with one component are connected, but not all connected
    nodes share one.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = _mark(e)
    for n in count(1):
        if not mark[0]:
            break
        # large star: each node's larger neighbours go to the least of it and its neighbours
        big = _with_least(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        big = big.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v")
        # small star: each node and its smaller neighbours go to the least of them
        low = _with_least(big)
        to = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        e = low.select(F.explode(to).alias("x")).select("x.u", "x.v").where("u <> v").distinct().checkpoint()
        if n == rounds:
            break
        mark, before = _mark(e), mark
        if mark == before:
            break
    least = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if rounds:  # a node may still be in the middle
        return nodes.union(least).groupBy("node").agg(F.min("component").alias("component"))
    return nodes.union(least)  # once settled, every other node has one edge, to its least


def _with_least(e: DataFrame) -> DataFrame:
    """Distinct edges with the least neighbour m of u, after one shuffle."""
    return e.repartition("u").dropDuplicates(["u", "v"]).withColumn("m", F.min("v").over(Window.partitionBy("u")))
