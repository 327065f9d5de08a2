"""Intermediate tables in the folder that driver and executors share, and small keyed state tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir (or setCheckpointDir) names it.

    Where neither is set, a folder is made only if driver and executors are one process; a cluster is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
    return context.getCheckpointDir()


def table_path(spark: SparkSession) -> str:
    """A new place below the folder of this application's intermediate tables."""
    return f"{_own(spark)}/{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quillgraph-{spark.sparkContext.applicationId}"


def released(spark: SparkSession) -> bool:
    """Remove this application's intermediate tables, once what was built on them is written or collected."""
    where = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame) -> DataFrame:
    """df written and read again: lineage ends here. The table stays until `released`."""
    path = table_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by key, those of `new` instead of old ones, the last by `order` if a key repeats."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_last", last).filter("_last = 1").drop("_new", "_last")
