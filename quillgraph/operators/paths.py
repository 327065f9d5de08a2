"""Paths over edge tables: reachability from some nodes, frontier by frontier with a visited set, or from every node,
from the ends backwards, and trails that repeat no edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.storage import saved, table_path

#: Nodes that the sets which make up one node's set may hold together, as it is made in one row.
SET_NODES = 1 << 16


def closure(edges: DataFrame, starts: DataFrame, most: int | None = None, least: int = 0) -> DataFrame:
    """start, node, hops, before: what directed edges (a, b) lead to from `starts` (node), by the fewest hops.

    hops is between `least` and `most` (null: no bound); before is the smallest node that comes last but one. Every
    round joins only what the last one found (semi-naive), and what was reached before is left out, so cycles end
    and the number of rounds is the longest shortest path. Each round is a written table.
    """
    spark, where = edges.sparkSession, table_path(edges.sparkSession)
    e = saved(edges.select("a", "b").filter("a is not null and b is not null").distinct())
    kind = dict(e.dtypes)["a"]
    schema, hop = f"start {kind}, node {kind}, before {kind}", 0
    begun = starts.select(F.col("node").cast(kind).alias("start")).filter("start is not null").distinct()
    begun.select("start", F.col("start").alias("node"), F.lit(None).cast(kind).alias("before")).write.parquet(f"{where}/hops=0")
    while most is None or hop < most:
        frontier = spark.read.schema(schema).parquet(f"{where}/hops={hop}")
        reached = spark.read.schema(schema).parquet(*[f"{where}/hops={h}" for h in range(hop + 1)]).select("start", "node")
        step = frontier.select("start", F.col("node").alias("a")).join(e, "a").groupBy("start", F.col("b").alias("node")).agg(F.min("a").alias("before"))
        hop += 1
        step.join(reached, ["start", "node"], "left_anti").write.parquet(f"{where}/hops={hop}")
        if spark.read.schema(schema).parquet(f"{where}/hops={hop}").isEmpty():
            break
    out = spark.read.option("basePath", where).schema(f"{schema}, hops int").parquet(where)
    return out.filter(F.col("hops") >= least).select("start", "node", "hops", "before")


def _depths(e: DataFrame, nodes: DataFrame, where: str) -> int:
    """Write each node (node) whose edges (a, b) all end to `where`/nodes/depth=n, n: its longest path. Returns the
    number of depths. A round joins the edges to the nodes of the last one; of what came before it looks only at
    nodes that it met."""
    spark, kind, depth = e.sparkSession, dict(nodes.dtypes)["node"], 0
    edges = saved(e.groupBy("a").agg(F.count(F.lit(1)).alias("edges")))
    nodes.join(edges, F.col("node") == F.col("a"), "left_anti").write.parquet(f"{where}/nodes/depth=0")
    while not (last := spark.read.schema(f"node {kind}").parquet(f"{where}/nodes/depth={depth}")).isEmpty():
        depth += 1
        e.join(last, F.col("b") == F.col("node")).groupBy("a").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{where}/met/depth={depth}")
        met = [spark.read.schema(f"a {kind}, n long").parquet(*[f"{where}/met/depth={d}" for d in some]) for some in ([depth], range(1, depth + 1))]
        ended = met[1].join(met[0].select("a"), "a", "left_semi").groupBy("a").agg(F.sum("n").alias("n")).join(edges, "a").filter("n = edges")
        ended.select(F.col("a").alias("node")).write.parquet(f"{where}/nodes/depth={depth}")
    return depth


def _joined(start, found, kind: str):
    """The set of a node from those of the nodes after it: lists of nodes by their hops, each node in the first list it can be in."""
    at = lambda h: F.flatten(F.transform(found, lambda one: F.coalesce(F.get(one, h - 1), F.array().cast(f"array<{kind}>"))))
    own = F.array(F.array(start)).cast(f"array<array<{kind}>>")
    longest = F.array_max(F.transform(found, F.size))
    lists = F.aggregate(F.sequence(F.lit(1), longest), own, lambda known, h: F.concat(known, F.array(F.array_except(at(h), F.flatten(known)))))
    return F.filter(lists, lambda one: F.size(one) > 0)


def closures(edges: DataFrame, most: int | None = None, size: int = SET_NODES) -> DataFrame:
    """start, node, hops: what directed edges (a, b) lead to from every one of their nodes, by the fewest hops; at most `most`.

    A node's set is joined from those of the nodes right after it, once all of these are known: sets are written once
    and sent once for each edge, however many levels there are, and nothing is compared with what was found before.
    Nodes that lead to a cycle, or to a set joined from more than `size` nodes, are left to `closure`.
    """
    spark, where = edges.sparkSession, table_path(edges.sparkSession)
    kind = dict(edges.dtypes)["a"]
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").cast(kind)))
    nodes = saved(ends.filter("node is not null").distinct())
    e = saved(edges.select("a", F.col("b").cast(kind).alias("b")).filter("a <> b").distinct())
    depths = _depths(e, nodes, where)
    # an edge lies with the depth of its start; a node knows at which depths its set is asked for
    known = spark.read.schema(f"node {kind}, depth int").parquet(f"{where}/nodes")
    laid = e.join(known, F.col("a") == F.col("node")).drop("node")
    laid.hint("rebalance", F.col("depth")).write.partitionBy("depth").parquet(f"{where}/edges")
    laid = spark.read.schema(f"a {kind}, b {kind}, depth int").parquet(f"{where}/edges")
    asked = laid.groupBy(F.col("b").alias("node")).agg(F.collect_set("depth").alias("asked"))
    count = laid.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("edges"))
    nodes_at = saved(known.join(asked, "node", "left").join(count, "node", "left"))
    sets = f"node {kind}, asked array<int>, n int, lists array<array<{kind}>>"
    own = F.array(F.array("node")).alias("lists")
    nodes_at.filter("depth = 0").select("node", "asked", F.lit(1).alias("n"), own).write.parquet(f"{where}/sets/depth=0")
    for depth in range(1, depths):
        here = laid.filter(F.col("depth") == depth).drop("depth")
        after = spark.read.schema(sets).parquet(*[f"{where}/sets/depth={d}" for d in range(depth)]).filter(F.array_contains("asked", depth)).withColumnRenamed("node", "b")
        met = here.join(after.select("b", "n"), "b").groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("met"), F.sum("n").alias("n"))
        fit = saved(nodes_at.filter(F.col("depth") == depth).join(met, "node").filter(f"met = edges and n <= {size}").select(F.col("node").alias("a"), "asked"))
        lists = F.col("lists") if most is None else F.slice("lists", 1, most)
        found = here.join(fit, "a", "left_semi").join(after.select("b", lists.alias("lists")), "b").groupBy("a").agg(F.collect_list("lists").alias("found"))
        joined = found.join(fit, "a").select(F.col("a").alias("node"), "asked", _joined(F.col("a"), F.col("found"), kind).alias("lists"))
        joined.select("node", "asked", F.size(F.flatten("lists")).alias("n"), "lists").write.parquet(f"{where}/sets/depth={depth}")
    made = spark.read.schema(sets).parquet(*[f"{where}/sets/depth={d}" for d in range(max(1, depths))])
    out = made.select(F.col("node").alias("start"), F.posexplode("lists").alias("hops", "nodes")).select("start", F.explode("nodes").alias("node"), "hops")
    left = saved(nodes.join(made.select("node"), "node", "left_anti"))
    return out if left.isEmpty() else out.unionByName(closure(e, left, most).select("start", "node", "hops"))


def trails(edges: DataFrame, starts: DataFrame, least: int, most: int | None = None, directed: bool = False) -> DataFrame:
    """start, node, hops, nodes: every path from `starts` (node) that goes over no edge twice, with `least` to `most` hops.

    Without `directed` an edge can be gone over both ways, once. Without `most` paths grow until no edge is left
    for any; there may be very many of them.
    """
    spark, where = edges.sparkSession, table_path(edges.sparkSession)
    kind = dict(edges.dtypes)["a"]
    e = edges.select("a", "b").filter("a is not null and b is not null")
    e = e.distinct() if directed else e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = saved(e.withColumn("edge", F.struct("a", "b")))
    steps = e if directed else saved(e.unionByName(e.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "edge")))
    schema = f"start {kind}, node {kind}, nodes array<{kind}>, gone array<struct<a:{kind},b:{kind}>>"
    begun = starts.select(F.col("node").cast(kind).alias("start")).filter("start is not null").distinct()
    none = F.array().cast(f"array<struct<a:{kind},b:{kind}>>")
    begun.select("start", F.col("start").alias("node"), F.array("start").alias("nodes"), none.alias("gone")).write.parquet(f"{where}/hops=0")
    hop = 0
    while most is None or hop < most:
        last = spark.read.schema(schema).parquet(f"{where}/hops={hop}")
        grown = last.withColumnRenamed("node", "a").join(steps, "a").filter(~F.array_contains("gone", F.col("edge")))
        hop += 1
        grown.select("start", F.col("b").alias("node"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("gone", F.col("edge")).alias("gone")).write.parquet(f"{where}/hops={hop}")
        if spark.read.schema(schema).parquet(f"{where}/hops={hop}").isEmpty():
            break
    out = spark.read.option("basePath", where).schema(f"{schema}, hops int").parquet(where)
    return out.filter(F.col("hops") >= least).select("start", "node", "hops", "nodes")


def shortest(edges: DataFrame, start, end) -> list:
    """The nodes of a shortest path from one node to another; empty if there is none. Smallest nodes win ties."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["a"]
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # from the end backwards: each node on the way names the next one
    to = saved(closure(back, spark.createDataFrame([(end,)], f"node {kind}")))
    at, out = to.filter(F.col("node") == F.lit(start)).first(), []
    while at is not None:
        out.append(at["node"])
        at = to.filter(F.col("node") == F.lit(at["before"])).first() if at["before"] is not None else None
    return out
