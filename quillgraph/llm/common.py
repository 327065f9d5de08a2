"""What the operators of this subpackage share: word patterns, the shared folder, cut lineage, hot keys, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.storage import saved

#: Runs of anything but the ASCII space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: What a Python worker gets at once, whatever the texts' lengths: a batch ends at either.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, lost executors cost nothing."""
    return saved(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*cols) -> Column:
    """A pseudorandom double in [0, 1) from the columns given."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by rows and bytes; smaller bounds set before stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def spread_join(left: DataFrame, right: DataFrame, key: list[str], counts: DataFrame, total: int, by: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on key, with the rows of hot keys dealt over several tasks.

    counts: key and n, the rows of left that hold it (none twice); total: all rows of left. A key is hot above
    total / 10,000 rows, so at most 10,000 keys are: that is the proven bound of what is broadcast here. A hot
    key's rows of left are dealt by a hash of the columns `by`, its rows of right are repeated for every deal.
    """
    most = max(64, -(-total // 10_000))
    hot = F.broadcast(counts.filter(F.col("n") > most).select(*key, F.ceil(F.col("n") / F.lit(most)).cast("int").alias("_ways")))
    dealt = left.join(hot, key, "left").withColumn("_deal", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_ways")).cast("int"), F.lit(0))).drop("_ways")
    # left outer, so that keys that aren't hot stay; explode gives each deal its copy
    copies = right.join(hot, key, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))).drop("_ways")
    return dealt.join(copies, [*key, "_deal"], how).drop("_deal")
