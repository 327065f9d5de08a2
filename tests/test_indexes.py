"""Indexes of a graph's tables: built when needed, read by the retrievers; the indexed store."""

import pytest
from pyspark.sql import functions as F

from quillgraph.models import Settings
from quillgraph.operators import vector_index as VI
from quillgraph.operators.storage import table_path
from quillgraph.plans import build, drift, indexes, retrieve

TEXTS = [
    "Marie Curie worked in Paris. Marie Curie discovered Polonium Metal with Pierre Curie in the Paris Laboratory.",
    "Pierre Curie taught physics. The Paris Laboratory was small. Polonium Metal is rare.",
    "Isaac Newton lived in England. Isaac Newton wrote about Natural Philosophy and the Royal Society.",
    "The Royal Society published Natural Philosophy. Robert Hooke was of the Royal Society.",
]


@pytest.fixture(scope="module")
def graph(spark):
    docs = spark.createDataFrame([(f"d{i}", text * 3) for i, text in enumerate(TEXTS)], "doc_id string, text string")
    return build.build(docs, Settings(chunk_size=120, overlap=20))


@pytest.fixture(scope="module")
def settings(spark, graph):
    return indexes.indexed(graph, table_path(spark), Settings(chunk_size=120, overlap=20))


def test_indexes_are_built_once_and_follow_the_tables(spark, graph, settings):
    assert set(settings.indexes) == {"chunks", "entities", "reports", "names"}
    names = indexes.names_of(graph)
    assert not indexes.current_names(names, settings.indexes["names"])
    assert indexes.current_names(names.limit(2), settings.indexes["names"]) and not indexes.current_names(names, settings.indexes["names"])
    for name in indexes.KEYS:
        path = settings.indexes[name]
        rows = indexes.vectors_of(graph, name, settings)
        assert VI.problems(spark, path, rows, dim=64) == [] and not indexes.current(rows, path, 64)
    some, where = indexes.vectors_of(graph, "chunks", settings), table_path(spark)
    assert indexes.current(some.limit(3), where, 64)
    assert not indexes.current(some, where, 64) and VI.problems(spark, where, some) == []  # rows that came were added
    changed = some.withColumn("embedding", F.transform("embedding", lambda x: -x))
    assert indexes.current(changed, where, 64) and VI.problems(spark, where, changed) == []


def test_retrievers_read_the_indexes(graph, settings, monkeypatch):
    scanned = {name: retrieve.ask(name, graph, "Marie Curie and Polonium Metal", Settings()) for name in ("vector", "store", "graph", "hybrid", "local")}
    reports = [r.community for r in drift.relevant_reports(graph, "Marie Curie", Settings(), 3).collect()]
    for scan in ("quillgraph.operators.vectors.top_k", "quillgraph.plans.catalog_text.bm25"):
        monkeypatch.setattr(scan, lambda *a: pytest.fail("a scan"))
    for name, want in scanned.items():
        got = retrieve.ask(name, graph, "Marie Curie and Polonium Metal", settings)
        assert got["error"] is None and len(got["retrieval_details"]) >= 1
        # the nearest is found; further ones may lie in cells that aren't read
        assert got["retrieval_details"][0]["metadata"] == want["retrieval_details"][0]["metadata"]
    assert [r.community for r in drift.relevant_reports(graph, "Marie Curie", settings, 3).collect()][:1] == reports[:1]


def test_indexed_store(spark, graph):
    where = table_path(spark)
    stored = indexes.build_indexed_store(graph["chunks"], where)
    asked = stored.limit(3).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    hits = indexes.store_search(spark, where, asked, 2, probes="all").collect()
    assert {r.query_id for r in hits} == {r.query_id for r in asked.collect()} and all(r.text for r in hits)
    best = {r.query_id: r for r in hits if r["rank"] == 1}
    assert all(r.cosine > 0.999 for r in best.values())
