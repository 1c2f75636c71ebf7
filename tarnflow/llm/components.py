"""Connected components by alternating large-star and small-star.

Each round joins every edge with the least neighbour of its ends; the least neighbour is a partial aggregation, so a hub with a third
of all edges sends one row per task, and its edges meet a single row in a join that adaptive execution may split. No list of
neighbours is ever built, and nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.runtime import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than u is linked to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and every lesser neighbour are linked to the least neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    lesser = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lesser.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(id, component): component is the least id of the component.

    edges: u and v of one ordered type; direction, loops, repeated edges and edges with a null end don't matter (a loop makes its
    vertex known). vertices: id, for those that may have no edge. Empty inputs give no rows.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null")
    now = cut(edges.where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    ids = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id")))
    if vertices is not None:
        ids = ids.unionByName(vertices.select("id").where("id is not null"))
    return ids.distinct().join(now.select(F.col("u").alias("id"), F.col("v").alias("__c")), "id", "left").select("id", F.coalesce("__c", "id").alias("component"))
