"""Answerability that follows ingestion: questions wait, as stored needs, for the titles that they still lack.

A batch appends its needs and its new titles, as its own partitions, and looks at those questions alone that it
touches: the ones it brings, and the ones that need a title it brings. All of that is joins and sums of Spark's own,
so a question costs a few rows, not a call of its own. A batch that runs again overwrites what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Needs that one task puts together by question.
ROWS = 1 << 20
NEEDS, TITLES, ANSWERABLE = "id string, title string", "title string", "id string, needed long"


def _events(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """id, needed, title: both streams as one; questions have no title, titles no id."""
    wanted = F.array_distinct(F.array_compact(F.coalesce("supporting", F.array().cast("array<string>"))))
    asked = questions.select(F.col("id").cast("string").alias("id"), wanted.alias("needed")).filter("id is not null and size(needed) > 0")
    known = titles.select(F.lit(None).cast("string").alias("id"), F.lit(None).cast("array<string>").alias("needed"), F.col("title").cast("string").alias("title"))
    return asked.select("id", "needed", F.lit(None).cast("string").alias("title")).unionByName(known.filter("title is not null"))


def answer_batch(spark: SparkSession, events: DataFrame, number: int, target: str) -> None:
    """What a batch of `_events` makes answerable, as the batch's own partition of `target`/answerable.

    Questions that came out before batch `number` count no more, whatever is asked of them later.
    """
    state = f"{target}/_state"
    events.filter("id is not null").select("id", F.explode("needed").alias("title")).write.mode("overwrite").parquet(f"{state}/needs/batch={number}")
    events.filter("title is not null").select("title").write.mode("overwrite").parquet(f"{state}/titles/batch={number}")
    stored = lambda path, schema: spark.read.schema(f"{schema}, batch long").parquet(path)
    needs, titles = stored(f"{state}/needs", NEEDS).filter(F.col("batch") <= number), stored(f"{state}/titles", TITLES).filter(F.col("batch") <= number)
    if number:
        touched = needs.join(titles.filter(F.col("batch") == number).select("title"), "title", "left_semi").select("id")
        touched = touched.unionByName(needs.filter(F.col("batch") == number).select("id")).distinct()
        given = stored(f"{target}/answerable", ANSWERABLE).filter(F.col("batch") < number)
        needs = needs.join(touched.join(given, "id", "left_anti"), "id", "left_semi")
    known = titles.select("title").distinct().withColumn("known", F.lit(1))
    # a title that very many questions need is one key of this join; Spark splits its rows
    met = needs.join(known, "title", "left").select("id", "title", "known")
    # by rows, as Spark's own number of tasks doesn't grow with them
    met = met.repartition(max(1, -(-needs.count() // ROWS)), "id").distinct()
    ready = met.groupBy("id").agg(F.count(F.lit(1)).alias("needed"), F.count("known").alias("found")).filter("needed = found")
    ready.select("id", "needed").write.mode("overwrite").parquet(f"{target}/answerable/batch={number}")


def follow(spark: SparkSession, questions: DataFrame, titles: DataFrame, target: str) -> StreamingQuery:
    """Start the stream of newly answerable questions into `target`/answerable and drain what there is.

    questions (id, supporting) and titles (title) are streams; either may come first. A question comes out once, when
    all its titles came. Questions without titles never come out, null titles don't count, titles and questions may
    be repeated; a question that is repeated with other titles before it came out needs all of them. State is below
    `target`/_state and progress below `target`/_answers: started again, it goes on where it ended.
    """
    spark.createDataFrame([], ANSWERABLE).write.mode("ignore").parquet(f"{target}/answerable/batch=-1")
    writer = _events(questions, titles).writeStream.foreachBatch(lambda batch, number: answer_batch(spark, batch, number, target))
    return writer.option("checkpointLocation", f"{target}/_answers").trigger(availableNow=True).start()


def ingested_titles(spark: SparkSession, target: str, title: Column | None = None, files_per_batch: int = 1000) -> DataFrame:
    """The stream of titles of what `ingest` stored below `target`; a document's id is its title, if none is given."""
    from quillgraph.streaming.ingest import DOCUMENTS

    # a batch that runs again replaces its files; its titles come again and count once
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).option("ignoreMissingFiles", True)
    return stream.parquet(f"{target}/documents").select((F.col("doc_id") if title is None else title).alias("title"))


def answerable(spark: SparkSession, target: str) -> DataFrame:
    """id, needed of the questions that came out so far."""
    return spark.read.schema(ANSWERABLE).parquet(f"{target}/answerable").select("id", "needed")
