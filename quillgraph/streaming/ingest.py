"""Incremental ingestion: a stream of documents, each micro-batch built and appended; the newest version counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.models import Settings
from quillgraph.plans.build import embedded_chunks

DOCUMENTS = "doc_id string, text string, batch bigint"


def ingest_batch(spark: SparkSession, batch: DataFrame, number: int, target: str, settings: Settings | None = None) -> None:
    """Documents of a batch that are not blank, and their chunks, as the batch's own partition.

    A batch costs what it holds, not what is stored. Run again, it overwrites its own output. Blank documents are
    listed as failures. A document that comes several times in a batch counts by its smallest text.
    """
    rows = batch.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    filled = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    docs = rows.filter(filled).groupBy("doc_id").agg(F.min("text").alias("text"))
    docs.write.mode("overwrite").parquet(f"{target}/documents/batch={number}")
    rows.filter(~filled).select("doc_id", F.lit("blank").alias("reason")).write.mode("overwrite").parquet(f"{target}/failures/batch={number}")
    stored = spark.read.schema("doc_id string, text string").parquet(f"{target}/documents/batch={number}")
    embedded_chunks(stored, settings or Settings()).write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")


def ingest_stream(spark: SparkSession, source: str, target: str, schema: str = "doc_id bigint, text string", files_per_batch: int = 50):
    """Start the stream over a folder of Parquet files and drain it; the checkpoint takes the place of a progress
    record."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, n: ingest_batch(spark, df, n, target)).option("checkpointLocation", f"{target}/_progress").trigger(availableNow=True)
    return writer.start()


def documents(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, text, batch: every document in its newest version."""
    newest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("batch")))
    return spark.read.schema(DOCUMENTS).parquet(f"{target}/documents").withColumn("_newest", newest).filter("_newest = 1").drop("_newest")


def chunks(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of every document's newest version; those of older ones don't count any more."""
    every = spark.read.parquet(f"{target}/chunks")
    return every.join(documents(spark, target).select("doc_id", F.col("batch").cast(every.schema["batch"].dataType).alias("batch")), ["doc_id", "batch"], "left_semi")


def failures(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("doc_id string, reason string, batch bigint").parquet(f"{target}/failures")


def remaining(docs: DataFrame, target: str) -> DataFrame:
    """Documents that no batch has stored yet."""
    done = docs.sparkSession.read.schema(DOCUMENTS).parquet(f"{target}/documents").select("doc_id").distinct()
    return docs.withColumn("doc_id", F.col("doc_id").cast("string")).join(done, "doc_id", "left_anti")
