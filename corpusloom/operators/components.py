"""Connected components of a pair table by alternating large-star and small-star rewrites.

Both rewrites are an aggregation (minimum neighbour, combined on the map side) followed by an equi join on the
vertex. Neighbour lists are never gathered, so a hub that owns a third of all pairs costs no task more than its
share: the aggregate combines early and the join back is split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import cut, cut_observed, release

#: Each round at least halves the depth of the label trees; the bound only guards against a fault.
MAX_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than the vertex is linked to the smallest of the vertex and its neighbours."""
    around = _both_ways(edges)
    low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The vertex and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _state() -> dict[str, Column]:
    """Count and sums of two hashes: equal for equal tables, and hardly ever otherwise."""
    return {"n": F.count(F.lit(1)), "a": F.sum(F.hash("u", "v").cast("decimal(38,0)")), "b": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}


def connected_components(pairs: DataFrame, left: str, right: str, vertex: str = "vertex", component: str = "component") -> DataFrame:
    """``(vertex, component)`` for each value of a pair; ``component`` is the smallest value reachable from it.

    Null sides: the row is ignored. A pair of a value with itself makes that value a vertex without links. Repeated
    pairs and either order count once. An empty table gives an empty result. Other columns are not looked at.
    """
    sides = pairs.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    sides = cut(sides.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    edges, table, before = sides.where("u <> v"), None, None
    for _ in range(MAX_ROUNDS):
        edges, after = cut_observed(_small_star(_large_star(edges)), **_state())
        if table is not None:  # the round before is not needed any more
            release(table)
        table = edges
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias(vertex), F.col("v").alias(component))
    roots = sides.select(F.col("v").alias(vertex)).unionAll(sides.select(F.col("u").alias(vertex))).distinct()
    return roots.join(stars, vertex, "left").select(vertex, F.coalesce(component, vertex).alias(component))
