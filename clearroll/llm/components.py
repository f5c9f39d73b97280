"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Every round links each node's larger neighbours, then its smaller ones, to the smallest
    node known near it.  The rows never exceed the edges, the smallest neighbour is a plain
    aggregate, and the hub of a star is a skewed join key, which adaptive execution splits.
    Each round is a written table, so its lineage is cut.  Raises if ``rounds`` do not do.
    """
    now = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if state == before or not state[0]:
            break
        before = state
        ends = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.join(least, now.lo == least.u).select("hi", F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        now = saved(moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
