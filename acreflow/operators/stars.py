"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, never a collected neighbourhood; edges stay linear in the nodes and
each round is a table in the shared folder, dropped after the next. Rounds grow with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreflow.sources.tables import dropped, settled


def _to_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v), and the least of u and u's neighbours as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above u links to the least of the neighbourhood."""
    return _to_least(_both(edges)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """u and its neighbours below link to the least of them. Edges come as u > v."""
    near = _to_least(edges)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (columns u and v, any order, of one comparable type) but the roots themselves.

    No edges: no rows. Loops and repeated edges are harmless."""
    now = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    sums = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    before = None
    while True:
        state = tuple(now.agg(*sums).first())
        if state == before or not state[0]:
            return now.select("u", F.col("v").alias("root"))
        before = state
        last, now = now, settled(_small(_large(now)))
        dropped(last)
