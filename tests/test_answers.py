"""Questions that become answerable as documents are ingested: keyed state, restarts, hand-made rows."""

import pytest
from pyspark.sql import functions as F

from quillgraph.streaming import answers, ingest

SCHEMA = "id string, supporting array<string>"


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "questions"), str(tmp_path / "docs"), str(tmp_path / "out")


def _drain(spark, asked, out):
    q = answers.follow(spark, spark.readStream.schema(SCHEMA).parquet(asked), answers.ingested_titles(spark, out), out)
    q.awaitTermination()
    return sorted(map(tuple, answers.answerable(spark, out).collect()))


def _put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_questions_come_out_once(spark, folders):
    asked, docs, out = folders
    rows = [("q1", ["a", "b", "b"]), ("q2", ["b", "c"]), ("q3", []), ("q4", None), (None, ["a"]), ("q5", [None, "a"]), ("q6", ["never"])]
    _put(spark, rows, SCHEMA, asked)
    _put(spark, [("a", "text one"), ("x", " "), ("b", "text")], "doc_id string, text string", docs)
    ingest.ingest_stream(spark, docs, out, "doc_id string, text string").awaitTermination()
    assert _drain(spark, asked, out) == [("q1", 2), ("q5", 1)]

    # questions and documents that come later, one document in a new version; state is read again from its folder
    _put(spark, [("c", "text"), ("a", "newer")], "doc_id string, text string", docs)
    _put(spark, [("q7", ["a"]), ("q1", ["a"]), ("q8", ["c", "d"])], SCHEMA, asked)
    ingest.ingest_stream(spark, docs, out, "doc_id string, text string").awaitTermination()
    assert _drain(spark, asked, out) == [("q1", 2), ("q2", 2), ("q5", 1), ("q7", 1)]
    assert _drain(spark, asked, out) == [("q1", 2), ("q2", 2), ("q5", 1), ("q7", 1)]


def test_a_title_that_all_questions_need(spark, tmp_path):
    asked, known, out = (str(tmp_path / n) for n in ("q", "t", "o"))
    spark.range(500).select(F.col("id").cast("string").alias("id"), F.array(F.lit("hot"), F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("supporting")).write.parquet(asked)
    spark.range(0, 50, 2).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("title")).union(spark.createDataFrame([("hot",)], "title string")).write.parquet(known)
    titles = spark.readStream.schema("title string").parquet(known)
    answers.follow(spark, spark.readStream.schema(SCHEMA).parquet(asked), titles, out).awaitTermination()
    assert {int(r.id) for r in answers.answerable(spark, out).collect()} == {i for i in range(500) if i % 50 % 2 == 0}


def test_a_question_costs_no_call_of_its_own(spark, tmp_path):
    asked, known, out = (str(tmp_path / n) for n in ("q", "t", "o"))
    _put(spark, [("q1", ["a"]), ("q2", ["b"])], SCHEMA, asked)
    _put(spark, [("a",)], "title string", known)
    query = answers.follow(spark, spark.readStream.schema(SCHEMA).parquet(asked), spark.readStream.schema("title string").parquet(known), out)
    query.awaitTermination()
    assert "Python" not in query._jsq.explainInternal(True) and not query.lastProgress.stateOperators


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    out, schema = str(tmp_path / "o"), "id string, needed array<string>, title string"
    batches = [[("q1", ["a", "b"], None), ("q2", ["b", "c"], None), (None, None, "a")], [(None, None, "b"), ("q1", ["b"], None)], [(None, None, "c"), ("q1", ["z"], None), ("q2", ["a"], None)]]
    spark.createDataFrame([], answers.ANSWERABLE).write.parquet(f"{out}/answerable/batch=-1")
    for number, rows in enumerate(batches):
        for _ in range(2):
            answers.answer_batch(spark, spark.createDataFrame(rows, schema), number, out)
    assert sorted(map(tuple, answers.answerable(spark, out).collect())) == [("q1", 2), ("q2", 3)]
