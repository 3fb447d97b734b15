"""Connected components by alternating large-star and small-star steps.

The edges stay a table throughout; only counts come to the driver. A step moves every vertex next
to the smallest vertex of its neighbourhood, so chains and stars both shrink in few steps, and the
number of edges never grows. A hub's edges are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, spread_join


def _to_least(edges: DataFrame, count: int) -> DataFrame:
    """(u, v, m): every edge with the smallest neighbour of u, or u if that is smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return spread_join(edges, least, ["u"], "n", count)


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both, 2 * count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    moved = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    return _to_least(edges, count).select(moved.alias("e")).select("e.u", "e.v").where("u != v").distinct()


def _state(edges: DataFrame) -> tuple[bool, int]:
    """Whether every vertex has one edge to a smaller one, or is such a smaller one only; and the
    number of edges."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root"))))
    by_vertex = edges.select(ends.alias("e")).select("e.*").groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    unsettled, count = by_vertex.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0))), F.sum("up")).first()
    return unsettled == 0, count or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (two columns of one type), where the
    component is the smallest vertex that can be reached."""
    a, b = edges.columns
    stars = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    while True:
        settled, count = _state(stars)
        if settled:
            break
        # A large star keeps the number of edges, a small one doesn't add to it.
        following = materialize(_small_star(_large_star(stars, count), count), "edges")
        discard(stars)
        stars = following
    roots = stars.select(F.col("v").alias("vertex")).distinct()
    return stars.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots.select("vertex", F.col("vertex").alias("component")))
