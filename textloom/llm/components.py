"""Connected components of a link table, by alternating large and small stars.

Each round writes its links to the shared folder.  A vertex's neighbours are only
ever compared with their least one, which is a partial aggregate.  It comes back to
them by ``spread_join``, so a vertex with many links needs no task that holds them all.
The rounds end when one aggregate over all links finds nothing but stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, spread_join


def _hook(links: DataFrame, both_ways: bool, total: int) -> DataFrame:
    """Tie each vertex's larger (or, not both ways, smaller) neighbours and itself to its least neighbour."""
    if both_ways:
        # large star: neighbours larger than the vertex are tied to its least neighbour
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        return spread_join(near.where("b > a"), least, ["a"], 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    # small star: a > b; the vertex and its smaller neighbours are tied to the least of them
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    tied = spread_join(links, least, ["a"], total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b")))


def _stars(links: DataFrame) -> bool:
    """Whether each vertex with a smaller neighbour has one only, which has none itself: links a > b are then final."""
    ends = links.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = ends.unionByName(links.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    vertices = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return not vertices.where("up > 1 OR up > 0 AND root > 0").limit(1).count()


def components(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(v, c) for each vertex of the links (a, b): c is the least vertex of its component."""
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = ws.save(links, f"{name}-links0", release=False)
    k = 0
    while not _stars(links):
        k += 1
        # either star has no more links than its rows: those of one vertex are distinct
        large = ws.save(_hook(links, True, links.count()).where("a > b").distinct(), f"{name}-large{k}", release=False)
        small = _hook(large, False, large.count()).where("a > b").distinct()
        links = ws.save(small, f"{name}-links{k}", release=False)
        ws.drop(f"{name}-links{k - 1}", f"{name}-large{k}")
    roots = links.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct()
    out = ws.save(links.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(roots), f"{name}-components")
    ws.drop(f"{name}-links{k}")
    return out
