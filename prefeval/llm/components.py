"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefeval.llm.common import materialize


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, wide: bool) -> DataFrame:
    """Large star: every larger neighbour of u moves to the least of u and its
    neighbours. Small star: u and its smaller neighbours move to the least.
    The least per node is a partial aggregate; the join back has one row per
    node on one side, so a hub's edges can be split over tasks."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if wide else edges
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    if wide:
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select("v", "m", "u")
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (least node reachable) of every node that has a link to
    another. Each round is written to the shared folder, so that a lost
    executor repeats one round; it stops when a round changes nothing."""
    edges = links.filter(F.col(a) != F.col(b)) \
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        edges = materialize(_star(_star(edges, True), False), "links")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
