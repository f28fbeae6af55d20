"""Connected components of an edge table, by alternating star contraction.

Each round makes every node point at its smallest neighbour (larger neighbours first, then
smaller ones), which halves the depth of each component, so the number of rounds grows with
the logarithm of the longest path. Only grouped minima and equi-joins are used; nothing is
collected and no task needs a whole component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexloom.plans.scratch import Scratch


def _stars(edges: DataFrame, scratch: Scratch, larger: bool) -> DataFrame:
    """edges(u, v) with u > v. Larger neighbours, or smaller ones, are moved to the minimum."""
    if larger:
        seen = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges
    least = scratch.save(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    moved = seen.join(least, "u")
    if larger:  # (v, m) for v > u
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # (v, m) for all smaller v, and (u, m)
        out = moved.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Works on any orderable column type. Edges with a null end and self-loops are ignored,
    repeated edges count once, no edges give an empty table. Nodes without edges are not in
    the result: callers join it from the left.
    """
    scratch = Scratch(edges.sparkSession, "components")
    a, b = F.col(src), F.col(dst)
    now = scratch.save(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = state(now)
    for _ in range(max_rounds):
        if was[0] == 0:
            break
        mid = scratch.save(_stars(now, scratch, True), "large")
        after = scratch.save(_stars(mid, scratch, False), "small")
        scratch.drop(mid)
        scratch.drop(now)
        now, is_ = after, state(after)
        if is_ == was:
            break
        was = is_
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
