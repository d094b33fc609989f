"""Connected components of an edge table, distributed: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _star(both: DataFrame, small: bool) -> DataFrame:
    """Every neighbour of u on one side is linked to the least neighbour of u."""
    near = both.filter("v < u") if small else both
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    side = near if small else both.filter("v > u")
    moved = side.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component of all ends of ``edges`` (a, b); the component is the least node reachable.

    A round costs four grouped shuffles of the edges and their table is written to the
    shared store, so lost executors repeat one round at most.  Rounds grow with the
    logarithm of the longest chain.
    """
    e = store.table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, small=False)
        new = store.table(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), small=True), "edges")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        store.drop(e)
        e = new
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().join(e.select(F.col("u").alias("node")), "node", "left_anti").withColumn("component", F.col("node"))
    return nodes.unionByName(roots)
