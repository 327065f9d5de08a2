"""Vector indexes of a graph's chunks, entities and reports, built when they are needed, and searches over them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.models import Settings
from quillgraph.operators import text_index as TI
from quillgraph.operators import vector_index as VI
from quillgraph.operators import vectors as V

#: Where each index's vectors come from: the table's id and the text that is embedded; chunks bring their own.
KEYS = {"chunks": "chunk_id", "entities": "id", "reports": "community"}


def vectors_of(graph: dict[str, DataFrame], name: str, settings: Settings) -> DataFrame:
    """vec_id, embedding of a graph's chunks, entities (name, and description where there is one) or reports."""
    rows, key = graph[name], F.col(KEYS[name]).alias("vec_id")
    if name == "chunks":
        return rows.select(key, "embedding")
    if name == "entities":
        told = F.concat_ws(": ", "name", F.when(F.length("description") > 0, F.col("description"))) if "description" in rows.columns else F.col("name")
        return rows.select(key, settings.embedder.column(F.lower(told) if "description" in rows.columns else told).alias("embedding"))
    if "report_vectors" in graph:
        return graph["report_vectors"].select(key, "embedding")
    return rows.filter(F.length("summary") > 0).select(key, settings.embedder.column(F.col("summary")).alias("embedding"))


def current(vectors: DataFrame, path: str, dim: int | None = None) -> bool:
    """An index at `path` that serves these vectors; whether anything had to be built.

    A missing index, one of another dimension and one whose rows changed are built anew; rows that only came are added.
    """
    spark = vectors.sparkSession
    found = VI.problems(spark, path, vectors, dim=dim)
    if found == ["stale"]:
        VI.added(vectors, path)
        found = VI.problems(spark, path, vectors, dim=dim)
    if not any(p == "missing" or p == "stale" or p.startswith("of ") or p.endswith("described") for p in found):
        return False
    VI.build(vectors, path)
    return True


def names_of(graph: dict[str, DataFrame]) -> DataFrame:
    """doc_id, text: what the full-text index of entities holds."""
    e = graph["entities"]
    told = F.concat_ws(" ", "name", "description") if "description" in e.columns else F.col("name")
    return e.select(F.col("id").alias("doc_id"), told.alias("text"))


def current_names(names: DataFrame, path: str) -> bool:
    """A text index at `path` that holds these entities; whether it had to be built. Entities that came are added,
    those that went make it be built anew."""
    found = TI.status(names.sparkSession, path, names)
    if len(found) == 1 and found[0].endswith("lacking"):
        TI.added(names, path)
        return False
    if found:
        TI.build(names, path)
    return bool(found)


def indexed(graph: dict[str, DataFrame], root: str, settings: Settings) -> Settings:
    """Settings whose searches read the indexes below `root`, which are brought up to date first."""
    paths = {}
    for name in KEYS:
        if name in graph and not (rows := vectors_of(graph, name, settings)).isEmpty():
            current(rows, f"{root}/{name}", settings.embedder.dim)
            paths[name] = f"{root}/{name}"
    if "entities" in graph:
        current_names(names_of(graph), f"{root}/names")
        paths["names"] = f"{root}/names"
    return replace(settings, indexes=paths)


def nearest(graph: dict[str, DataFrame], name: str, text: str, settings: Settings, k: int) -> DataFrame:
    """id, cosine, score, rank of the k rows nearest to a text: from the index the settings name, else by a scan."""
    spark = graph[name].sparkSession
    q = spark.createDataFrame([(text,)], "text string").select(settings.embedder.column(F.col("text")).alias("q"))
    if name in settings.indexes:
        return VI.search(spark, settings.indexes[name], q.withColumn("query_id", F.lit(0)), k).select("id", "cosine", "score", "rank")
    return V.top_k(vectors_of(graph, name, settings), q, k).withColumnRenamed("vec_id", "id")


def build_indexed_store(chunks: DataFrame, path: str, key: str = "chunk_id") -> DataFrame:
    """chunks (key, text, embedding and metadata) as the store at `path`/rows with an index beside it."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/store")
    rows = spark.read.parquet(f"{path}/store")
    VI.build(rows.select(F.col(key).alias("vec_id"), "embedding"), f"{path}/index")
    return rows


def store_search(spark, path: str, queries: DataFrame, k: int, key: str = "chunk_id", probes: int | str | None = None) -> DataFrame:
    """query_id, rank, cosine, score and a store's columns for the k rows nearest to each query (query_id, q).

    Equal scores are in the order of a hash of the text, then of ids.
    """
    found = VI.search(spark, f"{path}/index", queries, k, probes)
    rows = spark.read.parquet(f"{path}/store").drop("embedding")
    hits = rows.join(found.withColumnRenamed("id", key), key)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.xxhash64("text"), key)
    return hits.withColumn("rank", F.row_number().over(order))
