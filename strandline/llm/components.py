"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, join_summary


#: Links that one task takes at least; small sets of links are few tasks' work.
LINKS = 250_000


def _with_least(edges: DataFrame, split: bool) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours; split: a hub's edges may be more than a task's work."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return join_summary(edges, least, "u") if split else edges.join(least, "u")


def _large(edges: DataFrame, split: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, split).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, split: bool) -> DataFrame:
    x = _with_least(edges, split)
    return x.select("u", F.col("m").alias("v")).union(x.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """The count of edges, and whether they are stars: no node has two edges down, nor one down and one up."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    r = nodes.agg(F.sum("down").alias("n"), F.max((F.col("down") + F.col("up") > 1).cast("int")).alias("odd")).first()
    return r["n"] or 0, not r["odd"]


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (least reachable node) of every node that has a link to another; self-links and repeats are ignored.

    Nodes may be of any type that has an order. Each step rewires links towards the least neighbour seen, until all are
    stars around the least node; the count of steps grows with the logarithm of the longest path. Only the count of
    links comes to the driver, and a step's table goes when the next one is there.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        n, stars = _shape(edges)
        if stars:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()
        tasks = 1 + n // LINKS
        larger = _large(edges.coalesce(tasks), tasks > 1).coalesce(tasks).distinct().coalesce(tasks)
        before, edges = edges, cut(_small(larger, tasks > 1).coalesce(tasks).distinct().coalesce(tasks))
        free(before)
