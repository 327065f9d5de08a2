"""Operators on micro-graphs and hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import modularity as M
from quillgraph.operators import vectors as V
from quillgraph.operators.budget import budget_fold, running_sums
from quillgraph.operators.chunking import chunks, split_sections, split_text
from quillgraph.operators.components import connected, stars, triage
from quillgraph.operators.vectors import nearest_graph, similar_pairs

TRIANGLES = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]


def test_two_triangles_make_two_communities(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in TRIANGLES], "a long, b long, w double")
    found = M.levels(edges)
    top = found.agg(F.max("level")).first()[0]
    place = found.filter(F.col("level") == top).select("node", "community")
    groups = {}
    for r in place.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6]]
    assert abs(M.modularity(edges, place) - 0.357142857) < 1e-6


def test_levels_only_merge(spark):
    edges = spark.createDataFrame([(i, (i * 7 + 3) % 40, 1.0) for i in range(40) if i != (i * 7 + 3) % 40], "a long, b long, w double")
    rows = M.levels(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")).collect()
    by = {(r.level, r.node): r.community for r in rows}
    for level in range(max(r.level for r in rows)):
        up = {}
        for n in {r.node for r in rows}:
            assert up.setdefault(by[level, n], by[level + 1, n]) == by[level + 1, n]


def test_components_and_triage(spark):
    pairs = spark.createDataFrame([(1, 2, 0.97), (2, 3, 0.95), (7, 9, 0.86), *[(20 + i, 21 + i, 0.99) for i in range(30)]], "src long, dst long, similarity double")
    comp = connected(pairs)
    assert {r.node: r.component for r in comp.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7} | {20 + i: 20 for i in range(31)}
    assert {r.component: r.decision for r in triage(pairs, comp).collect()} == {1: "merge", 7: "verify", 20: "review"}
    assert connected(pairs.limit(0)).count() == 0


def test_similar_pairs_by_blocks(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [0.9, 0.1]), (6, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for size in (2, 100):
        assert sorted((r.src, r.dst) for r in similar_pairs(v, 0.95, rows=size).collect()) == [(1, 2), (1, 5), (2, 5)]
    assert nearest_graph(similar_pairs(v, 0.95), 1).count() == 3


def test_budgets(spark):
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate([5, 9, 2, 4])], "p string, o long, tokens long")
    assert [r.o for r in G.budget_prefix(rows, 10, [F.col("o")], per=("p",)).collect()] == [0]
    assert sorted(r.o for r in budget_fold(rows, 10, "o", "tokens", "skip", "p").collect()) == [0, 2]
    assert sorted((r.o, r.bin) for r in budget_fold(rows, 10, "o", "tokens", "bins", "p").collect()) == [(0, 0), (1, 1), (2, 2), (3, 2)]


def test_intermediate_tables_go_when_released(spark):
    from quillgraph.operators.storage import released, saved

    assert saved(spark.range(3)).count() == 3
    assert released(spark) and not released(spark)
    assert saved(spark.range(4)).count() == 4


def test_budget_laws_over_blocks(spark):
    import random

    rng = random.Random(3)
    items = {p: [rng.choice([0, 1, 3, 7, 12, 30, 200]) for _ in range(rng.randrange(1, 300))] for p in ("a", "b", "c")}
    rows = spark.createDataFrame([(p, i, x) for p, xs in items.items() for i, x in enumerate(xs)], "p string, o long, tokens long").repartition(5)
    skip, bins, sums = set(), set(), set()
    for p, xs in items.items():
        used, filled, number, running = 0, None, 0, 0
        for i, x in enumerate(xs):
            running += x
            sums.add((p, i, running))
            if used + x <= 100:
                used += x
                skip.add((p, i, 0))
            if filled is not None and filled + x > 100:
                number, filled = number + 1, x
            else:
                filled = (filled or 0) + x
            bins.add((p, i, number))
    assert {(r.p, r.o, r.bin) for r in budget_fold(rows, 100, "o", "tokens", "skip", "p").collect()} == skip
    assert {(r.p, r.o, r.bin) for r in budget_fold(rows, 100, "o", "tokens", "bins", "p").collect()} == bins
    assert {(r.p, r.o, r.running) for r in running_sums(rows, "tokens", ["p"], [F.col("o")]).collect()} == sums


def test_quantiles_by_brackets(spark):
    import numpy as np

    from quillgraph.operators.quantiles import quantiles

    rng = np.random.default_rng(4)
    for values in (rng.normal(size=5001), rng.integers(0, 4, 3000).astype(float), np.array([7.0]), np.full(2000, 2.5)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").cache()
        for most in (100, 10**6):
            assert np.allclose(quantiles(df, "v", [0.0, 0.33, 0.67, 0.95, 1.0], most), np.quantile(values, [0.0, 0.33, 0.67, 0.95, 1.0]))
    assert quantiles(df.limit(0), "v", [0.5]) == [None]


def test_rewiring_drops_loops_and_adds_up(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (1, 3, 4)], "a long, b long, n long")
    mapping = spark.createDataFrame([(2, 1), (1, 1)], "node long, primary long")
    assert [tuple(r) for r in G.rewired(edges, mapping).collect()] == [(1, 3, 6)]


def test_first_writer_fills_nulls_only(spark):
    rows = spark.createDataFrame([("k", 1, None, "x"), ("k", 2, "b", "y"), ("k", 3, "c", "z")], "k string, o int, u string, v string")
    assert tuple(G.first_written(rows, "k", F.col("o"), "u", "v").first()) == ("k", "b", "x")


def test_splitter(spark):
    text = "\n".join(f"line {i} " + "word " * (i % 9) for i in range(60))
    parts = split_text(text, 100, 20)
    assert all(len(p) <= 100 for p in parts) and set("".join(text.split())) == set("".join("".join(parts).split()))
    assert all(w in " ".join(parts) for w in text.split())
    assert split_text("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50] and split_text(None) == []
    assert split_sections("intro\nSection 1. One\nbody a\nChapter 2\nbody b") == [(None, "intro"), ("Section 1. One", "body a"), ("Chapter 2", "body b")]
    d = spark.createDataFrame([(1, text), (2, None), (3, "  ")], "doc_id long, text string")
    rows = chunks(d, size=100, overlap=20).collect()
    assert {r.doc_id for r in rows} == {"1"} and [r["index"] for r in rows] == list(range(len(rows)))


def test_mentions_are_dealt_over_tasks_by_their_number(spark):
    m = spark.range(4000).select((F.col("id") % 1000).alias("chunk"), F.floor(F.col("id") / 7).alias("entity"))
    pairs = G.co_mentions(m, size=100)
    held = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 20 and max(r["count"] for r in held) < 4 * 6 * 100
    plain = m.withColumnRenamed("entity", "x").join(m, "chunk").filter("x < entity").count()
    assert sum(r["count"] for r in held) == plain
    assert {(r.a, r.b): r.n for r in G.co_occurrences(m).collect()} == {(r.a, r.b): r.n for r in pairs.groupBy("a", "b").agg(F.count("a").alias("n")).collect()}


def test_pairs_of_a_task_leave_few_stars(spark):
    pairs = spark.range(0, 200_000, 1, 4).select((F.col("id") % 97 + 1000).alias("u"), (F.col("id") * 7 % 89).alias("v"))
    assert stars(pairs).count() < 4 * (97 + 89)
    assert {r.component for r in connected(pairs, "u", "v").collect()} == {0}


def test_blocks_grow_where_cells_leave_nothing_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(rng.normal(size=(3000, 16)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(V, "CELL_ROWS", 20)
        m.setattr(V, "LEAST_ROWS", 20)
        met, _, _ = V._blocks(vectors, 0.2, "vec_id", None)
        # with 150 cells rows would visit 75 of them, and be sent to more blocks
        assert met.count() < 2 * V.BLOCKS * 3000
