"""Connected components of a graph of any size, by alternating large-star and small-star steps.

Every step replaces edges by edges to smaller neighbours and keeps connectivity (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). A vertex with very many neighbours is no hot group: its smallest
neighbour is found by a map-side minimum and brought back by a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.scratch import Scratch


def _with_smallest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) plus the smallest ``v`` of each ``u``."""
    # The expression on the key keeps both sides of the join behind exchanges of their own, which can be split.
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("key"), "m")
    return edges.join(least, F.col("u") == F.col("key")).drop("key")


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", name: str = "stars") -> DataFrame:
    """``node, root`` for every vertex that is not the smallest of its component; ``root`` is the smallest.

    Self-loops and repeated edges do no harm; no edges give no rows.
    """
    current = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct()
    current, before, turn = scratch.write(current, f"{name}0"), None, 0
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).first()
        if mark == before or mark[0] == 0:
            return current
        before, turn = mark, turn + 1
        both = current.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(current.select(F.col("root"), F.col("node")))
        # Large star: larger neighbours go to the smallest of the vertex and its neighbours.
        large = _with_smallest(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Small star: smaller neighbours and the vertex itself go to the smallest one.
        tied = _with_smallest(large)
        small = tied.select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.col("m").alias("root")), F.struct(F.col("u").alias("node"), F.col("m").alias("root")))).alias("e")).select("e.node", "e.root")
        step = scratch.write(small.filter("node != root").distinct(), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        current = step
