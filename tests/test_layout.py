"""Laid-out graphs: the same rows as joins over plain tables, and plans that move no row of the graph."""

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import layout as L


@pytest.fixture(scope="module")
def plain(spark):
    rows = [(c, e) for c in range(200) for e in {0, c % 7 + 1, c % 11 + 10, c % 13 + 30}]  # entity 0 is everywhere
    m = spark.createDataFrame(rows + rows[:20] + [(None, 3), (5, None)], "chunk long, entity long")
    return m, G.co_occurrences(m)


@pytest.fixture(scope="module")
def layout(spark, plain, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("layout"))
    L.laid_out(*plain, root, "tested", size=50)
    return root, L.attached(spark, root, "tested")


@pytest.fixture
def seeds(spark):
    return spark.createDataFrame([(0,), (3,), (3,), (12,), (999,)], "entity long")


def _scans_without_exchange(df, table):
    """Whether no exchange lies between the joins of a plan and the scans of `table`."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = [i for i, s in enumerate(lines) if "FileScan" in s and table in s]
    for i in at:
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-*()0123456789"))
        for s in reversed(lines[:i]):
            d = len(s) - len(s.lstrip(" :+-*()0123456789"))
            if d < depth:
                depth = d
                if "Join" in s:
                    break
                if "Exchange" in s:
                    return False
    return bool(at)


def test_same_rows(layout, plain, seeds):
    _, tables = layout
    m, edges = plain
    assert tables["nodes"].filter("node = 0").first().mention_parts == 4
    assert {r.part for r in tables["mentions_by_entity"].filter("node = 0").collect()} == {0, 1, 2, 3}
    assert sorted(map(tuple, L.together(tables).collect())) == sorted(map(tuple, G.co_mentions(m).collect()))
    assert list(map(tuple, L.outside(tables, seeds, 10).collect())) == list(map(tuple, G.outside_neighbours(edges, seeds.distinct(), 10).collect()))
    want = m.dropna().distinct().join(seeds.distinct(), "entity").groupBy("chunk").count()
    assert sorted(map(tuple, L.mentioning(tables, seeds).collect())) == sorted(map(tuple, want.collect()))
    known = {r.entity for r in seeds.collect()}
    both = {(a, b, n) for x, y, n in map(tuple, edges.collect()) for a, b in ((x, y), (y, x)) if a in known}
    assert {tuple(r) for r in L.neighbours(tables, seeds).collect()} == both


def test_plans(spark, layout, seeds):
    _, tables = layout
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with seeds and tables of any size
    try:
        for df, table in [(L.together(tables), "mentions_by_chunk"), (L.neighbours(tables, seeds), "edges_by_node"), (L.mentioning(tables, seeds), "mentions_by_entity")]:
            assert _scans_without_exchange(df, table), df._jdf.queryExecution().executedPlan().toString()
        assert not _scans_without_exchange(tables["nodes"].join(tables["nodes"].withColumnRenamed("node", "x"), F.col("node") == F.col("x") + 1), "nodes")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_another_session_and_odd_input(spark, layout, tmp_path):
    root, tables = layout
    again = L.attached(spark.newSession(), root, "elsewhere")
    assert again["edges_by_node"].count() == tables["edges_by_node"].count()
    with pytest.raises(ValueError):
        L.attached(spark, root, "a; b")
    none = spark.createDataFrame([], "chunk long, entity long")
    L.laid_out(none, G.co_occurrences(none), str(tmp_path / "none"), "hollow")
    empty = L.attached(spark, str(tmp_path / "none"), "hollow")
    assert L.neighbours(empty, spark.createDataFrame([(1,)], "entity long")).count() == 0 and L.together(empty).count() == 0


def test_chunks_meet_in_small_buckets(spark, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "MEETING", 40)
    L.laid_out(*plain, str(tmp_path), "meeting")
    tables = L.attached(spark, str(tmp_path), "meeting")
    buckets = {n: int(spark.sql(f"describe extended meeting_{n}").filter("col_name = 'Num Buckets'").first()["data_type"]) for n in tables}
    assert buckets["mentions_by_chunk"] * 40 >= tables["mentions_by_chunk"].count() > 8 * 40 and buckets["edges_by_node"] == 8
    assert sorted(map(tuple, L.together(tables).collect())) == sorted(map(tuple, G.co_mentions(plain[0]).collect()))
