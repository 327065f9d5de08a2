"""The corpus pipeline: toxicity, line dedup, near-duplicates, source mixing, packing.

Every stage is written as Parquet and read again as the next one's documents. Of odd input: null and empty texts
and rows without doc_id pass all stages but the mix, which takes documents with words only; rows repeated with one
doc_id are one document and go or stay together; ties go to the smaller doc_id; an empty table gives no rows;
further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import line_dedup, mixing, near_dup, packing, toxicity
from quillgraph.llm.common import table, written


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels table."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def repeated_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur or nearly occur earlier go; so do documents of which nothing is left."""
    lines = line_dedup.dedup_lines(docs, drop_blank=True)
    return lines.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else lines


def one_of_each_group_stays(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles, the one with the smallest id stays."""
    gone = near_dup.near_duplicates(docs, width=5, percent=80, halves=10).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line dedup", repeated_lines_go),
    ("near-duplicates", one_of_each_group_stays),
    ("source mixing", sources_mixed),
    ("packing", packed),
]

#: No SQL: the stages train a model, hash and tokenise; tests/llm holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
