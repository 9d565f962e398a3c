"""Connected components by alternating large-star and small-star over an edge table.

The least neighbour of each node comes from an aggregate with partial sums. It meets the node's edges again by a merge join at
every size; hubs, which hold more than one in HUB_PART of the edges and of which there can only be a bounded number, are broadcast
instead, so that no key of that join is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import Scratch

HUB_PART, HUB_LEAST = 500, 64  # at most 2 * HUB_PART nodes have more than 1 / HUB_PART of the edges at one of their two ends


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def with_least(near: DataFrame, least: Column, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """near with m, an aggregate over the edges of each u, in the column `m`; and u and m alone."""
    found = near.groupBy("u").agg(least.alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(HUB_LEAST, n_edges // HUB_PART)
    hubs = F.broadcast(found.where(hub).select("u", F.col("m").alias("of_hub")))
    # edges of hubs find their m here; in the join below they match nothing and are dealt by their other end. `deal` is a hash on both
    # sides: of a constant the optimizer makes a plain condition, and u alone would be the key
    dealt = near.join(hubs, "u", "left").withColumn("deal", F.when(F.col("of_hub").isNull(), F.xxhash64("u")).otherwise(F.xxhash64("v")))
    rest = found.where(~hub).select("u", F.xxhash64("u").alias("deal"), "m")
    return dealt.join(rest.hint("merge"), ["u", "deal"], "left").select("u", "v", F.coalesce("of_hub", "m").alias("m")), found.select("u", "m")


def large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself."""
    near, _ = with_least(both_ways(edges), F.least(F.min("v"), F.first("u")), n_edges)
    return near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near, least = with_least(down, F.min("v"), n_edges)
    moved = near.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and component (the least node that it reaches) for every node of the edges u - v.

    Loops and repeated edges are allowed; edges with a null end are ignored. Each round is written to the shared
    folder; rounds go on until the edges no longer change, which takes about the logarithm of the longest path.
    """
    edges = edges.where(F.col("u") != F.col("v")).select("u", "v").distinct()
    now = scratch.table(edges, f"{name}-0")
    seen, round_ = None, 0
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    while (state := mark(now)) != seen:
        seen, round_ = state, round_ + 1
        now = scratch.table(small_star(large_star(now, state[0]), state[0]), f"{name}-{round_}")
        scratch.drop(f"{name}-{round_ - 1}")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
