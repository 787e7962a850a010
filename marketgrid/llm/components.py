"""Connected components of an edge table by alternating star contraction; no neighbourhood is ever collected.

The smallest neighbours are written before they are joined back: AQE splits a hot key of a join only where both
sides come straight from a shuffle, and the centre of a star may hold most of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _pull(edges: DataFrame) -> DataFrame:
    """(u, v): each larger neighbour v of u is linked with the smallest neighbour of u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _push(edges: DataFrame) -> DataFrame:
    """(u, v) with v < u: the smaller neighbours of u and u itself are linked with the smallest of them."""
    low = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    joined = edges.join(low, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges(u, v)``: comp is the smallest node that can be reached.

    The edge table keeps its size at most; its rows halve their distance to the smallest node in each
    round, so the rounds grow with the logarithm of a component's width. Each round is written and read
    again, so a lost executor costs one round. Null ends and self links are ignored; an empty table gives
    an empty table.
    """
    edges = stored(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_push(_pull(edges)))
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
