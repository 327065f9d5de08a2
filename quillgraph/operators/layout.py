"""A graph laid out for its joins: bucketed, sorted tables whose joins move no row of the graph.

mentions lie by chunk and by entity, edges by either end. A node with very many rows is dealt over parts, so that no
bucket holds much more than `ROWS`; how many parts a node has is known from its row among the nodes. A layout is a
folder: its tables are files there, and a session that does not know them yet is told of them by `attached`.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.storage import saved

#: Rows that one bucket, and one part of a hot node, should hold.
ROWS = 1 << 20
#: Mentions that one bucket of chunks should hold: they meet themselves there, and their pairs take far more memory.
MEETING = 1 << 17
#: What rows are bucketed and sorted by.
KEYS = {"mentions_by_chunk": ["chunk"], "mentions_by_entity": ["node", "part"], "edges_by_node": ["node", "part"], "nodes": ["node"]}


def _part(parts: Column, other: Column) -> Column:
    return F.pmod(F.xxhash64(other), parts).cast("int")


def _counted(rows: DataFrame, name: str, size: int) -> DataFrame:
    """node, n, `name`: into how many parts each node's rows are dealt."""
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias(f"n_{name}")).withColumn(name, F.ceil(F.col(f"n_{name}") / size).cast("int"))


def _dealt(rows: DataFrame, nodes: DataFrame, parts: str, other: str) -> DataFrame:
    """rows with their part. Only hot nodes are joined, at most one for each `size` rows; Spark broadcasts them if they
    are within its bound, and splits the hot keys of the join if not."""
    hot = nodes.filter(F.col(parts) > 1).select("node", F.col(parts).alias("_parts"))
    return rows.join(hot, "node", "left").withColumn("part", F.coalesce(_part(F.col("_parts"), F.col(other)), F.lit(0))).drop("_parts")


def laid_out(mentions: DataFrame, edges: DataFrame, root: str, name: str, size: int = ROWS) -> None:
    """Write mentions (chunk, entity) and edges (a, b, n) as the layout `name` in the folder `root`.

    Repeated mentions count once; mentions without chunk or entity and edges without an end are left out.
    """
    spark = mentions.sparkSession
    m = saved(mentions.select("chunk", F.col("entity").alias("node")).dropna().distinct())
    # from one pass over the edges
    way = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("other"), "n")
    e = saved(edges.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*").dropna(subset=["node", "other"]))
    nodes = saved(_counted(m, "mention_parts", size).join(_counted(e, "edge_parts", size), "node", "full").na.fill(0))
    tables = {
        "mentions_by_chunk": m.withColumnRenamed("node", "entity"),
        "mentions_by_entity": _dealt(m, nodes, "mention_parts", "chunk"),
        "edges_by_node": _dealt(e, nodes, "edge_parts", "other"),
        "nodes": nodes,
    }
    known = []
    for table, df in tables.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        known.append({"table": table, "columns": columns, "buckets": _buckets(df.count(), min(size, MEETING) if table == "mentions_by_chunk" else size)})
    for k in known:
        _wiped(spark, f"{root}/{k['table']}")
    spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/layout")
    attached(spark, root, name)
    for k in known:
        # rows go to the task of their bucket first, so a bucket is one file
        order = KEYS[k["table"]]
        tables[k["table"]].repartition(k["buckets"], *order).sortWithinPartitions(*order).write.insertInto(_name(name, k["table"]), overwrite=True)


def _buckets(rows: int, size: int) -> int:
    """A power of two, as tables of different bucket counts can then meet without moving either; Spark's own bound is
    100,000 buckets, beyond which buckets grow."""
    return 1 << min(16, max(3, math.ceil(math.log2(max(1, rows / size)))))


def _name(name: str, table: str) -> str:
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"no name of a layout: {name!r}")
    return f"{name}_{table}"


def _wiped(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def attached(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    """The tables of a layout, made known to this session as `name`_`table`."""
    known = json.loads(spark.read.text(f"{root}/layout", wholetext=True).first()[0])
    for k in known:
        keys = ", ".join(KEYS[k["table"]])
        spark.sql(f"drop table if exists {_name(name, k['table'])}")
        spark.sql(f"create table {_name(name, k['table'])} ({k['columns']}) using parquet clustered by ({keys}) sorted by ({keys}) into {k['buckets']} buckets location '{root}/{k['table']}'")
    return {k["table"]: spark.table(_name(name, k["table"])) for k in known}


def _parted(layout: dict[str, DataFrame], seeds: DataFrame, parts: str) -> DataFrame:
    """seed, part of the seeds (entity) that are known: the side that moves."""
    some = layout["nodes"].join(seeds.select(F.col("entity").alias("node")).distinct(), "node").filter(F.col(parts) > 0)
    return some.select(F.col("node").alias("seed"), F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias("seed_part"))


def neighbours(layout: dict[str, DataFrame], seeds: DataFrame) -> DataFrame:
    """seed, other, n: the edges at the seeds (entity)."""
    s, e = _parted(layout, seeds, "edge_parts"), layout["edges_by_node"]
    return e.join(s, (e["node"] == s["seed"]) & (e["part"] == s["seed_part"])).select("seed", "other", "n")


def outside(layout: dict[str, DataFrame], seeds: DataFrame, k: int) -> DataFrame:
    """node, n: neighbours of seeds that are no seeds, by the number of edges to seeds."""
    known = seeds.select(F.col("entity").alias("other")).distinct()
    found = neighbours(layout, seeds).join(known, "other", "left_anti").groupBy(F.col("other").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("n"), "node").limit(k)


def mentioning(layout: dict[str, DataFrame], seeds: DataFrame) -> DataFrame:
    """chunk, seeds: how many of the seeds (entity) a chunk mentions."""
    s, m = _parted(layout, seeds, "mention_parts"), layout["mentions_by_entity"]
    hits = m.join(s, (m["node"] == s["seed"]) & (m["part"] == s["seed_part"]))
    return hits.groupBy("chunk").agg(F.count(F.lit(1)).alias("seeds"))


def together(layout: dict[str, DataFrame]) -> DataFrame:
    """chunk, a, b: every two entities a < b of one chunk, joined where they lie."""
    m = layout["mentions_by_chunk"]
    return m.alias("x").join(m.alias("y"), (F.col("x.chunk") == F.col("y.chunk")) & (F.col("x.entity") < F.col("y.entity"))).select("x.chunk", F.col("x.entity").alias("a"), F.col("y.entity").alias("b"))
