"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link every node's larger (large star) or smaller (small star) neighbours to the smallest one known.

    The minimum is a partial aggregate, so a hub with many links costs one row a task.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    if small:
        # every edge has u > v: the smaller neighbours and u itself join the smallest neighbour
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges (u, v bigint); component is the smallest node reachable.

    Nodes without an edge do not appear; self-loops, repeated edges and nulls are ignored.
    Each round is cut with a checkpoint; the number of rounds grows with the logarithm of the graph.
    """
    now = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or (state.n, state.h) == before:
            break
        before = (state.n, state.h)
        now = cut(_star(_star(now, small=False), small=True))
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
