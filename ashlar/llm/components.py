"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join; a vertex with many neighbours
costs its tasks one row each in the minimum, and a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _large_star(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Link every neighbour greater than a vertex to the least of the vertex and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Read back, either side of the join is a table, and a vertex with very many neighbours can be split.
    least = scratch.keep(least, name)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Link a vertex and its lesser neighbours to the least of them. Edges lead from greater to lesser."""
    least = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` and ``component``, its least node, for each vertex of edges ``u``, ``v`` that isn't itself the least.

    Nulls and loops are no edges; edges may repeat and point either way.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.keep(edges, f"{name}0")
    step, seen = 0, None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == seen or not now.n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        step, seen = step + 1, now
        large = scratch.keep(_large_star(scratch, edges, f"{name}{step}least"), f"{name}{step}large")
        edges = scratch.keep(_small_star(scratch, large, f"{name}{step}lesser"), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}", *(f"{name}{step}{x}" for x in ("least", "large", "lesser")))
