"""The built graph, retrievers, iterative search, text queries, sources, state and streaming."""

import json

import pytest

from quillgraph.models import Settings
from quillgraph.plans import build, drift, retrieve, textquery
from quillgraph.sources import readers
from quillgraph.streaming import ingest

TEXTS = [
    (1, 'Marie Curie worked with Pierre Curie in Paris. The "Radium Institute" was founded there.'),
    (2, 'Pierre Curie taught near the "Radium Institute" and Marie Curie followed. Irene Joliot came later.'),
    (3, "Ada Lovelace wrote to Charles Babbage about the Analytical Engine. Charles Babbage answered Ada Lovelace."),
]


@pytest.fixture(scope="module")
def built(spark):
    return build.build(spark.createDataFrame(TEXTS, "doc_id long, text string"), Settings(similarity=0.9))


def test_build(built):
    ids = {r.id for r in built["entities"].collect()}
    assert {"NAME_marie_curie", "PHRASE_radium_institute", "NAME_charles_babbage"} <= ids
    assert all(r.a < r.b for r in built["edges"].collect())
    levels = {r.level for r in built["reports"].collect()}
    assert 0 in levels and all(r.member_count > 0 for r in built["reports"].collect())
    ends = {x for r in built["edges"].collect() for x in (r.a, r.b)}
    assert ends <= {r.primary for r in built["mapping"].collect()}


def test_retrievers_answer(built):
    for name in ("vector", "graph", "hybrid", "local", "global", "routed", "drift"):
        got = retrieve.ask(name, built, "What did Marie Curie do in Paris?")
        assert got["error"] is None and got["method"] == name and got["retrieval_details"], name
    assert retrieve.ask("vector", built, "Marie Curie Paris", k=1)["retrieval_details"][0]["metadata"]["id"].startswith(("1_", "2_"))
    with pytest.raises(KeyError):
        retrieve.ask("nothing", built, "?")


def test_laid_out_graph_answers_alike(built, tmp_path):
    ready = build.preloaded(built, str(tmp_path / "layout"), "engine")
    question = "What did Marie Curie do in Paris?"
    assert retrieve.ask("hybrid", ready, question)["retrieval_details"] == retrieve.ask("hybrid", built, question)["retrieval_details"]


def test_action_graph():
    g = drift.ActionGraph()
    g.add(drift.Action("a", 0, "x", 50, True))
    assert g.add(drift.Action("b", 1, score=1), "a") and g.add(drift.Action("c", 1, score=3), "a") and not g.add(drift.Action("c"), "b")
    assert [a.query for a in g.ranked(1, 5)] == ["c", "b"] and g.path("a", "c") == ["a", "c"]
    again = drift.ActionGraph.load(json.loads(json.dumps(g.dump())))
    assert again.edges == g.edges and again.actions == g.actions


def test_text_queries(spark, built):
    assert not textquery.read_only("DROP TABLE x") and not textquery.read_only("select 1; drop table x")
    assert textquery.read_only("select 'drop table x' as SET_")
    built["entities"].createOrReplaceTempView("entities")
    text, verdict, tries = textquery.refine(spark, "```sql\nSELCT id, name, FORM entities;\n```")
    assert verdict.valid and len(tries) == 2 and spark.sql(text).count() > 0
    assert textquery.check_plan(spark, "select nothing from entities").issues[0] == "AnalysisException"
    rows, note = textquery.run_capped(spark, "select id from range(60)", 50)
    assert len(rows) == 50 and note
    assert "Curie" in retrieve.ask("text2query", built, "What is known about Curie")["final_answer"]


def test_sources_and_state(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"_id": "x", "question": "?", "supporting_facts": [["A", 0], ["B", 1]], "context": [["A", ["s"]], ["C", ["t"]]]}, {"id": "y", "question": "!"}]))
    q = readers.questions(spark, str(tmp_path / "q.json"))
    assert {r.id: r.type for r in q.collect()} == {"x": "unknown", "y": "unknown"}
    assert sorted(r.title for r in readers.referenced_titles(q).collect()) == ["A", "B", "C"]
    known = spark.createDataFrame([("A",), ("B",)], "title string")
    assert [r.id for r in readers.testable(q, known).collect()] == ["x"] and readers.testable(q, known, "all").count() == 0
    (tmp_path / "b.jsonl").write_text('{"question": "a", "ground_truth": "b"}\nnot json\n')
    assert readers.benchmark_jsonl(spark, str(tmp_path / "b.jsonl")).count() == 1
    (tmp_path / "b.csv").write_text("question;ground_truth;category;best_retriever\nq1;a1;c;r\n")
    assert tuple(readers.benchmark_csv(spark, str(tmp_path / "b.csv")).first()) == ("q1", "a1")
    state = str(tmp_path / "state")
    for value, at in (("one", 1), ("two", 2)):
        readers.write_state(spark, state, spark.createDataFrame([("k", value, at)], "key string, value string, at int"), "key", "at")
    schema = "key string, value string, at int"
    assert [tuple(r) for r in readers.read_state(spark, state, schema).collect()] == [("k", "two", 2)]
    (tmp_path / "state/v=9").mkdir()  # a version that was never finished
    assert readers.read_state(spark, state, schema).count() == 1
    assert readers.delete_state(spark, state, schema, "key", ["other"]).count() == 1
    assert readers.delete_state(spark, state, schema).count() == readers.read_state(spark, state, schema).count() == 0
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.PDF").write_bytes(b"hello")
    (tmp_path / "pdf/b.pdf").write_bytes(b" ")
    got = {r.name: r.error for r in readers.pdf_documents(spark, str(tmp_path / "pdf"), lambda b: b.decode()).collect()}
    assert got == {"a.PDF": None, "b.pdf": "no text"}
    perf = [{"impl": "x", "success": True, "total_ms": float(v)} for v in (1, 2, 3)] + [{"event": "warm_retriever_init"}]
    (tmp_path / "p.json").write_text(json.dumps(perf))
    assert "| x | 3 | 3 | 2.0 | 2.9 |" in readers.latency_report(readers.perf_rows(spark, str(tmp_path / "p.json")))


def test_stream_ingests_and_resumes(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "some text"), (2, " ")], "doc_id long, text string")
    docs.write.parquet(source)
    ingest.ingest_stream(spark, source, target).awaitTermination()
    assert [r.doc_id for r in ingest.documents(spark, target).collect()] == ["1"]
    assert [(r.doc_id, r.reason) for r in ingest.failures(spark, target).collect()] == [("2", "blank")]
    spark.createDataFrame([(1, "newer text"), (3, "third")], "doc_id long, text string").write.mode("append").parquet(source)
    ingest.ingest_stream(spark, source, target).awaitTermination()
    assert {r.doc_id: r.text for r in ingest.documents(spark, target).collect()} == {"1": "newer text", "3": "third"}
    assert {r.doc_id: r.text for r in ingest.chunks(spark, target).collect()} == {"1": "newer text", "3": "third"}
    assert ingest.remaining(docs, target).count() == 1


def test_store_and_checks(spark, tmp_path):
    store = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("a", "y", [0.0, 1.0, 0.0])], "chunk_id string, text string, embedding array<double>")
    path = str(tmp_path / "store")
    assert readers.store_size(spark, path) == 0
    readers.build_store(store, path)
    readers.build_store(store, path)
    assert readers.store_size(spark, path) == 2
    found = readers.schema_problems({"store": store}, {"store": ["chunk_id", "doc_id"], "reports": ["id"]}, {"store": "chunk_id"}, 2)
    assert found == ["reports: missing", "store.doc_id: missing", "store.chunk_id: not unique", "store.embedding: not of 2 numbers"]
    assert readers.wiped(spark, str(tmp_path), ["store", "nothing"]) == {"store": 0, "nothing": 0}


def test_communities_reports_and_vectors(built):
    again = build.with_communities(built, reports_only=True)
    assert again["reports"].count() == built["reports"].count() and set(build.counts(again)) >= {"chunks", "reports"}
    vectors = build.embedded_reports(built["reports"], Settings())
    first = vectors.limit(1)
    assert build.embedded_reports(built["reports"], Settings(), first).count() == vectors.count() == built["reports"].count()
    assert build.document_mentions(built["mentions"]).count() <= built["mentions"].count()
    assert drift.report_problems(built["reports"])["without_vector"] == built["reports"].count()
    broken = built | {"reports": built["reports"].filter("level > 0"), "report_vectors": first}
    assert {r.with_vector for r in build.hierarchy_report(built).collect()} == {0}
    mended = build.repaired_hierarchy(broken, Settings())
    assert mended["reports"].count() == built["reports"].count() == mended["report_vectors"].count()
    assert all(r.total == r.with_summary == r.with_vector for r in build.hierarchy_report(mended).collect())
    assert build.consents(0.05) and not build.consents(0.2) and build.consents(0.2, True)


def test_resolution_asks_and_reviews(spark):
    rows = [(f"N_{i}", n, "N") for i, n in enumerate(["acme corp one", "Acme Corp One", "acme corp two", "far away"])]
    found = spark.createDataFrame(rows, "id string, name string, kind string")
    settings = Settings(knn_cutoff=0.5)
    to = lambda **o: {r.node: r.primary for r in build.resolved(found, settings, **o)[0].collect()}
    assert to() == {"N_0": "N_0", "N_1": "N_0", "N_2": "N_2", "N_3": "N_3"}
    near = Settings(knn_cutoff=0.5)
    decisions = build.resolved(found, near)[1].collect()
    assert [d.decision for d in decisions] == ["ignore"]


def test_building_from_lists_and_folders(spark, tmp_path):
    g = build.build_texts(spark, [TEXTS[0][1], " ", TEXTS[1][1]], ["a"], "p", lean=True)
    assert {r.doc_id for r in g["documents"].collect()} == {"p_a_0", "p_unknown_2"}
    (tmp_path / "pdf").mkdir()
    for i, text, *_ in TEXTS:
        (tmp_path / f"pdf/{i}.pdf").write_bytes(text.encode())
    (tmp_path / "pdf/bad.pdf").write_bytes(b" ")
    root, folder = str(tmp_path / "store"), str(tmp_path / "pdf")
    out = build.build_directory(spark, folder, root, parse=lambda b: b.decode(), discover=lambda d: ["NAME"])
    assert out["labels"] == ["NAME"] and [e["name"] for e in out["errors"]] == ["bad.pdf"] and out["rows"]["documents"] == 3
    assert build.build_directory(spark, folder, root, mode="add")["rows"]["reports"] == out["rows"]["reports"] > 0
    with pytest.raises(ValueError):
        build.build_directory(spark, folder, root, mode="other")


def test_hybrid_and_local_contexts(spark, built):
    got = retrieve.ask("hybrid", built, "Marie Curie in Paris")
    ids = [d["metadata"]["id"] for d in got["retrieval_details"]]
    assert got["error"] is None and any(i.startswith("1_chunk") for i in ids)
    above = retrieve.with_ancestors(built, built["members"].filter("level = 0").select("community").distinct())
    assert above.count() >= built["members"].filter("level = 0").select("community").distinct().count()
    assert retrieve.full_text(built["entities"], "a (curie) AND/or?", 5).count() >= 2 and retrieve.full_text(built["entities"], "? !", 5).count() == 0
    seeds = retrieve.seed_entities(built, "Marie Curie", Settings(), 5, exclude=["Marie Curie"])
    assert "NAME_marie_curie" not in {r.entity for r in seeds.collect()}
    assert "exceed" in retrieve.ask("local", built, "x", community=0.8, text=0.5)["error"]
    none = built | {"entities": built["entities"].limit(0)}
    assert len(retrieve.ask("local", none, "x")["retrieval_details"]) == 3
    mapped = retrieve.ask("global", built, "Which themes has marie curie", strategy="map_reduce")
    assert mapped["error"] is None and mapped["final_answer"]
    assert retrieve.ask("global", built, "zz", strategy="map_reduce")["final_answer"]


def test_iterative_search(built):
    out, how = drift.primed_all(built, ["Who is Marie Curie?", "Ada?"], Settings())
    assert how["failed"] == 0 and all(x["expanded"].startswith(x["query"]) and len(x["follow_ups"]) <= 3 for x in out)
    bad, how = drift.primed_all(built, ["x"], Settings(model=lambda p: 1 / 0))
    assert how["failed"] == 1 and bad[0]["score"] == 0
    state = drift.explore(built, "Marie Curie", Settings())
    assert state.depth("Marie Curie") == 0 and state.tokens()["completed"] >= 1 and state.info("Marie Curie")["steps"] == 0
    assert drift.point_of('{"response": "r", "score": "70", "follow_up_queries": ["q"]}') == {"answer": "r", "score": 70.0, "follow_ups": ["q"]}
    assert drift.point_of("words")["score"] == 50.0 and drift.point_of('{"score": "x"}')["score"] == 50.0
    got = retrieve.ask("legacy_drift", built, "Marie Curie")
    assert got["error"] is None and got["final_answer"]
    assert drift.relevant_reports(built, "Marie Curie", Settings(), 2).count() <= 2


def test_query_rules_and_agent(spark, built):
    for text in ("", "select from x", "select a from where b", "select a from x where", "select a from x where b in ()", "select a, from x", "select (a from x", "select a from x where b == 1"):
        assert not textquery.check_syntax(text).valid, text
    assert textquery.check_syntax("select ')' as a from x where b = 'is == ('").valid
    assert textquery.corrected("select a from x where b == null and") == "select a from x where b IS NULL"
    assert textquery.corrected("SELECT FROM x", ("nothing is selected",)) == "SELECT * FROM x"
    seen = []
    got = retrieve.ask("agent", built, "How many entities", generate=lambda p: seen.append(p) or "SELECT count(*) AS n FROM entities")
    assert got["retrieval_details"] and "entities (" in seen[0] and "e.g." in seen[0]
    for q in ("How many chunks", "What is most mentioned", "What is connected to Curie", "What types are there", "Which documents name Curie", "passages about Radium", "main topics", "What is known about Curie"):
        assert retrieve.ask("agent", built, q)["retrieval_details"], q
    t = textquery.tools(built)
    assert "edges" in t["get_schema"]() and t["read_query"]("select count(*) as n from chunks").startswith("n=")


def test_models_and_presets():
    import asyncio

    from quillgraph import models

    async def slow(prompt):
        return prompt + "!"

    assert asyncio.run(models.invoke(slow, "a")) == "a!" and asyncio.run(models.invoke(lambda p: p, "b")) == "b"
    assert models.make("embedder", "hash", dim=8).dim == 8 and models.preset("mini")["questions"] == 10 and "micro" in models.presets()
    for f in (lambda: models.make("model", "x"), lambda: models.preset("x")):
        with pytest.raises(KeyError):
            f()
    mine = models.Settings(budget=1)
    assert models.current(mine) is models.current() is mine
    models.reset()
    assert models.current().budget == 8000
    assert models.configuration_problems(models.Settings(overlap=2000), {"chunks": 64, "reports": 8, "none": None}) == ["reports: 8 numbers, the embedder has 64", "overlap: not below the chunk size"]


def test_tokens_by_vocabulary(spark):
    places = pytest.importorskip("public_tokenizers")
    import tokenizers
    from pyspark.sql import functions as F

    from quillgraph.models import VocabularyTokens

    model = tokenizers.Tokenizer.from_file(str(places.path("byte_bpe_50k.json")))
    texts = ["", "plain words, and 12 numbers", "Größe überall\n\n  x", None]
    counter = VocabularyTokens(str(places.path("byte_bpe_50k.tiktoken")), places.PATTERN)
    got = [r.n for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").coalesce(1).select("i", counter.column(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [len(model.encode(x).ids) if x else 0 for x in texts]


def test_tables_and_articles(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"one;two")
    (tmp_path / "pdf/b.pdf").write_bytes(b"")
    broken = lambda b: 1 / 0
    start = spark.createDataFrame([], "doc_id string, chunks long")
    got = readers.pdf_tables(spark, str(tmp_path / "pdf"), [broken, lambda b: b.decode().split(";")], start, 2).collect()
    assert sorted((r["index"], r.text, r.type) for r in got) == [(0, "on", "table"), (1, "tw", "table")]
    titles = spark.createDataFrame([("A b",), ("C",), ("A b",), (" ",)], "title string")
    cache = str(tmp_path / "cache")
    find = lambda t: {"text": t.lower(), "summary": "s" * 900} if t != "C" else None
    assert [(r.title, r.text, len(r.summary)) for r in readers.fetched_articles(titles, find, cache).collect()] == [("A b", "a b", 500)]
    again = readers.fetched_articles(titles, lambda t: {"text": "new"}, cache).collect()
    assert {r.title: r.text for r in again} == {"A b": "a b", "C": "new"}
    readers.save_corpus(titles, str(tmp_path / "corpus"))
    assert readers.load_corpus(spark, str(tmp_path / "corpus")).count() == 4 and readers.title_of("p_Some_title_3") == "Some_title"
