"""Connected components of a link table by alternating large and small stars, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v) edges with u > v.

    Large: larger neighbours of each node go to its smallest neighbour or itself. Small: a node and its smaller
    neighbours go to the smallest. The minimum meets map-side first; a hot node is an ordinary skewed join.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): the smallest id reachable, for every id in a link. No links: no rows."""
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = written(edges), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.hash("u", "v"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        edges = written(_stars(_stars(edges, True), False))
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
