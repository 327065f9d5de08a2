"""Data sources: question sets as the JSON reader gives them, run folders that commit or leave nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import formats, readers


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    assert formats.registered(spark) == ["evaluation_runs", "question_sets"]


def test_question_sets(spark, tmp_path):
    asked = [{"_id": "a", "question": "Q?", "answer": "x", "type": "bridge", "level": "hard", "supporting_facts": [["T", "0"], ["U", "1"]], "context": [["T", "s"]]}, {"id": "b", "question": "R?"}, {"id": None, "question": None, "answer": None, "type": "comparison"}]
    for name, rows in [("one.json", asked), ("two.json", [{"id": "c", "question": "S?", "type": "bridge"}]), ("none.json", []), ("other.txt", [{"id": "z"}])]:
        (tmp_path / name).write_text(json.dumps(rows))
    got = spark.read.format("question_sets").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 3
    want = readers.questions(spark, f"{tmp_path}/*.json")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert [r.id for r in got.filter("type = 'bridge'").orderBy("id").collect()] == ["a", "c"] and got.count() == 4
    assert spark.read.format("question_sets").load(str(tmp_path / "one.json")).count() == 3
    (tmp_path / "empty").mkdir()
    assert spark.read.format("question_sets").load(str(tmp_path / "empty")).count() == 0


rows = lambda df: sorted(map(str, df.collect()))


def _files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def test_runs(spark, tmp_path):
    root = str(tmp_path / "runs")
    scored = spark.range(40).select(F.col("id"), F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("approach"), F.array(F.lit("c"), F.lit(None)).alias("contexts"), F.when(F.col("id") > 5, 0.5).alias("score"))
    put = lambda df, run, mode="append": df.write.format("evaluation_runs").option("run", run).mode(mode).save(root)
    put(scored.drop("score").repartition(3), "run_1")
    put(scored.repartition(2), "run_2")
    both = spark.read.format("evaluation_runs").load(root)
    some = lambda runs: spark.read.format("evaluation_runs").option("runs", runs).load(root)
    assert both.columns == ["run", "id", "approach", "contexts", "score"]
    assert both.rdd.getNumPartitions() == 5 and some("run_1").rdd.getNumPartitions() == 3
    assert rows(some("run_1")) == rows(both.filter("run = 'run_1'")) and some("run_1, run_2").count() == 80 == both.count() and some("run_9").count() == 0
    assert rows(both.filter("run = 'run_2'").drop("run")) == rows(scored)
    assert both.filter("run in ('run_1', 'nothing') and score is null").count() == 40 and both.filter("run = 'run_1' and run = 'run_2'").count() == 0

    # a write that fails leaves what was there, and nothing of its own
    before = _files(root)
    broken = scored.withColumn("score", F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("double"))
    for run, mode in [("run_3", "append"), ("run_2", "overwrite")]:
        with pytest.raises(Exception, match="broken"):
            put(broken, run, mode)  # other tasks have written theirs
        assert _files(root) == before and not os.path.isdir(f"{root}/run_3")
    with pytest.raises(Exception, match="is there"):
        put(scored, "run_2")
    put(scored.filter("id < 7").coalesce(1), "run_2", "overwrite")
    both = spark.read.format("evaluation_runs").load(root)  # its files were listed before
    assert both.filter("run = 'run_2'").count() == 7 and len(_files(f"{root}/run_2")) == 2 and len(os.listdir(f"{root}/run_2")) == 2
    put(scored.limit(0), "run_4")
    both = spark.read.format("evaluation_runs").load(root)
    assert both.groupBy("run").count().count() == 2
    for run in ("", "a/b", "_x"):
        with pytest.raises(Exception, match="names the run"):
            put(scored, run)
    with pytest.raises(Exception, match="no run"):
        spark.read.format("evaluation_runs").load(str(tmp_path / "nowhere"))
