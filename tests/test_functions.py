"""Column functions against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.models import HashEmbedder, route


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.x, 9) for r in rows.select(C.cosine("a", "b").alias("x")).collect()] == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("pred,truth,em,f1", [("The Eiffel Tower!", "eiffel tower", 1, 1), ("a b", "b c", 0, 2 / 3), ("", "", 1, 1), ("x", "", 0, 0), ("b b c", "b c c", 0, 2 / 3)])
def test_answers(spark, pred, truth, em, f1):
    assert one(spark, C.exact_match(F.col("p"), F.col("t")), p=pred, t=truth) == em
    assert abs(one(spark, C.token_f1(F.col("p"), F.col("t")), p=pred, t=truth) - f1) < 1e-9


@pytest.mark.parametrize("text,want", [("YES ", "yes"), ("The answer is Paris", "paris"), ("Answer: no, Rome", "rome"), ("Yes it is so. " + "x" * 60, "yes"), ("Nothing at all. " + "y" * 60, "no"), ("Paris is it. " + "z" * 60, "paris is it")])
def test_short_answer(spark, text, want):
    assert one(spark, C.short_answer(F.col("t")), t=text) == want


def test_keys_and_patterns(spark):
    assert one(spark, C.entity_key(F.lit("ORG"), F.col("n")), n=" Acme Corp ") == "ORG_acme_corp"
    assert one(spark, C.lucene_safe(F.col("q")), q="a/b + (c) && d") == "a b c d"
    assert one(spark, C.rich_patterns_any(F.col("t")), t='see NASA HQ and "some thing"\n- first item') == "NASA HQ | some thing | first item"
    assert C.query_terms("Who wrote the THE wrote 1984 abc") == ["wrote", "1984"]
    assert one(spark, C.context_recall(F.col("t"), F.col("c")), t="A b c d", c="a B x") == 0.5


def test_percentages(spark):
    assert abs(one(spark, C.speedup_percent(F.col("a"), F.col("b")), a=30.0, b=10.0) - 200) < 1e-9
    assert one(spark, C.speedup_percent(F.col("a"), F.col("b")), a=30.0, b=0.0) is None
    assert one(spark, C.improvement_percent(F.col("a"), F.col("b")), a=0.0, b=1.0) is None


def test_offline_models(spark):
    e = HashEmbedder(16)
    v = one(spark, e.column(F.col("t")), t="Two words")
    assert len(v) == 16 and abs(sum(x * x for x in v) - 1) < 1e-6
    assert set(one(spark, e.column(F.col("t")), t="")) == {0.0}
    assert route("Summarise the overall themes") == "GLOBAL" and route("Who is X?") == "LOCAL"
