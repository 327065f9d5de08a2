"""Relational graph operators over edge tables (a, b) with a < b: upserts, degrees, expansion, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Mentions that one task of a join with themselves holds: their pairs are a few times as many.
MENTIONS = 1 << 17


def co_mentions(mentions: DataFrame, size: int = MENTIONS) -> DataFrame:
    """(chunk, a, b) for two entities a < b of one chunk, each entity counted once per chunk.

    Chunks are dealt over as many tasks as there are `size` mentions, as a task's pairs, and what is grouped from
    them, take far more memory than its mentions, by whose bytes Spark would put tasks together.
    """
    m = mentions.select("chunk", "entity")
    m = m.repartition(max(1, -(-m.count() // size)), "chunk").distinct()
    return m.alias("x").join(m.alias("y"), (F.col("x.chunk") == F.col("y.chunk")) & (F.col("x.entity") < F.col("y.entity"))).select("x.chunk", F.col("x.entity").alias("a"), F.col("y.entity").alias("b"))


def co_occurrences(mentions: DataFrame) -> DataFrame:
    return co_mentions(mentions).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def first_written(rows: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """By key, each value's first non-null writer in `order`: later writers fill nulls only."""
    return rows.groupBy(key).agg(*[F.min_by(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(v) for v in values])


def upserted_edges(rows: DataFrame) -> DataFrame:
    """Edges by unordered pair: how often, the highest confidence, and the evidence that came with it."""
    pair = (F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    best = F.max_by("evidence", F.struct("confidence", F.col("evidence")))
    return rows.filter("src != dst").groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), best.alias("evidence"))


def comentioned(mentions: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Chunks that mention seeds, by how many distinct ones."""
    hit = mentions.join(seeds, "entity", "left_semi").groupBy("chunk").agg(F.count_distinct("entity").alias("seeds"))
    return hit.orderBy(F.desc("seeds"), "chunk").limit(k)


def between_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    s = seeds.select(F.col("entity").alias("s"))
    return edges.join(s, F.col("a") == F.col("s"), "left_semi").join(s, F.col("b") == F.col("s"), "left_semi")


def outside_neighbours(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Neighbours of seeds that are no seeds, by the number of edges to seeds."""
    s = seeds.select(F.col("entity").alias("s"))
    out = both_ways(edges).join(s, F.col("a") == F.col("s"), "left_semi").join(s, F.col("b") == F.col("s"), "left_anti")
    return out.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(k)


def rewired(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after merging nodes (node -> primary): self-loops go, parallel edges add up."""
    m = lambda c: mapping.select(F.col("node").alias(c), F.col("primary").alias(f"{c}_to"))
    e = edges.join(m("a"), "a", "left").join(m("b"), "b", "left")
    a, b = F.coalesce("a_to", "a"), F.coalesce("b_to", "b")
    return e.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), "n").filter("x != y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("n").alias("n"))


def budget_prefix(rows: DataFrame, budget: int, order: list, tokens: str = "tokens", per: tuple[str, ...] = (), least: int = 0) -> DataFrame:
    """Rows in order until the running sum of tokens first exceeds the budget.

    least: the tokens that every row has at least. Where that is known, no more than budget / least rows of a group
    can fit, so every input partition lets no more of its first ones pass, and the sum runs over few rows.
    """
    if least > 0:
        first = Window.partitionBy(*per, "_part").orderBy(*order)
        rows = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= max(budget, 0) // least).drop("_part", "_at")
    w = Window.partitionBy(*per).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(tokens).over(w)).filter(F.col("running") <= budget)
