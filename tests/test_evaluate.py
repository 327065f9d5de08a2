"""Samples, label discovery, relations, contexts, question selection and scores on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.jsonrepair import balanced, repaired
from quillgraph.models import Settings
from quillgraph.operators import sampling as S
from quillgraph.plans import contexts, discovery, evaluate, relations
from quillgraph.sources import readers

LONG_TEXT = "ALPHA BETA met. " + " ".join(f"This is a plain sentence number {i} of some length." for i in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, LONG_TEXT.replace("plain", f"plain{i % 7}") + f' "quoted {i}"', f"s{i % 3}") for i in range(24)] + [(99, " ", None)]
    return S.records(spark.createDataFrame(rows, "doc_id long, text string, source string"), source="source")


def test_repaired_json():
    for text, want in [
        ('```json\n{"a": [1, 2,], }\n```', {"a": [1, 2]}),
        ('so: {"a": {"b": "}"}} and more }', {"a": {"b": "}"}}),
        ('{"a": [{"b": 1}, {"b": 2', {"a": [{"b": 1}, {"b": 2}]}),
        ('{"a": 1, "b":', {"a": 1}),
        ('{"a": "cut of', {"a": "cut of"}),
        ('["x\ny"]', ["x y"]),
        ('{"a": "\\"{"}', {"a": '"{'}),
    ]:
        assert json.loads(repaired(text)) == want, text
    assert repaired("no json") is None and repaired(None) is None and repaired("{a}") is None
    assert balanced("f(a[1], '(') {x}") == "" and "closes nothing" in balanced("a)") and "another" in balanced("(a]") and "not closed" in balanced("((a)")


def test_samples(spark, docs):
    assert docs.count() == 24 and {r.metadata["type"] for r in docs.collect()} == {"text"}
    p = S.pattern_samples(docs, 200).collect()
    assert p and sum(len(r.sample) for r in p) <= 200 and all("ALPHA BETA" in r.sample and r.sample.startswith("[Patterns - s") for r in p)
    m = S.middle_sentences(docs).collect()
    assert len(m) == 48 and {r.k for r in m} == {1, 2} and all(len(r.sentence) > 30 for r in m)
    assert sorted(map(tuple, m)) == sorted(map(tuple, S.middle_sentences(docs).collect()))
    rows = spark.createDataFrame([(0, 1, "aa"), (0, 2, "A a"), (1, 1, "b" * 9), (1, 2, "cc"), (2, 1, "a  A")], "part int, k long, sample string")
    assert [r.sample for r in S.combined(rows, 11).collect()] == ["aa", "A a"]  # 4 + 5, 11 more don't fit, nor do 4
    assert [r.sample for r in S.combined(rows, 13).collect()] == ["aa", "A a", "cc"]
    s = S.corpus_sample(docs, 2000).collect()
    assert {r.part for r in s} >= {1, 2} and sum(len(r.sample) + 2 for r in s) <= 2000
    o = S.older_sample(docs, files=3, edge=100, budget=500).collect()
    assert [r.doc_id for r in o] == [0, 1] and sum(len(r.sample) for r in o) <= 500 and o[0].sample.startswith("Document: s0")


def test_labels(spark, docs, tmp_path):
    assert discovery.labels_of('Sure: ["PERSON", "Place", "X", 3, "AB C"]', 5) == ["PERSON", "AB C"]
    assert discovery.labels_of("none", 5) == discovery.FALLBACK
    assert discovery.discover("x", lambda p: 1 / 0) == discovery.FALLBACK
    assert discovery.approved(["A", "B", "C"], "3,1,9") == ["C", "A"] and discovery.approved(["A"], "n") == discovery.BASIC
    with pytest.raises(ValueError):
        discovery.approved(["A"], "x")
    calls = []
    find = lambda d: calls.append(1) or discovery.discover_corpus(d, budget=2000)
    first = discovery.cached_labels(spark, docs, str(tmp_path / "labels"), find)
    assert "ALPHA" in first and discovery.cached_labels(spark, docs.repartition(3), str(tmp_path / "labels"), find) == first and len(calls) == 1
    discovery.cached_labels(spark, docs.limit(5), str(tmp_path / "labels"), find)
    assert len(calls) == 2


def test_relations_by_strategy(spark):
    chunks = spark.createDataFrame([("c1", "Ann met Bob. Cid left."), ("c2", " ".join(f"N{i}" for i in range(9)))], "chunk_id string, text string")
    m = [("c1", "Ann", "P", 0), ("c1", "Bob", "P", 8), ("c1", "Cid", "P", 13)] + [("c2", f"N{i}", "P", 3 * i) for i in range(9)]
    mentions = spark.createDataFrame([(c, n, k, p, f"{k}_{n.lower()}") for c, n, k, p in m], "chunk_id string, name string, kind string, pos int, entity string")
    smart = relations.related(chunks, mentions)
    got = {(r.a, r.b) for r in smart.collect()}
    assert ("P_ann", "P_bob") in got and not any("cid" in x for pair in got for x in pair) and ("P_n0", "P_n1") in got
    assert relations.related(chunks, mentions, "implicit").count() == 0
    assert ("P_bob", "P_cid") in {(r.a, r.b) for r in relations.related(chunks, mentions, "adjacent").collect()}
    failing = relations.related(chunks, mentions, model=lambda t, e: 1 / 0)
    assert {r.a[:3] for r in failing.collect()} == {"P_n"}
    s = spark.createDataFrame([("a", "d | e"), ("b", None)], "id string, context string")
    assert {r.id: r.summary for r in relations.summarised(s).collect()} == {"a": "d", "b": None}
    one = spark.createDataFrame([("d", ["r"] * 12, [])], "d string, r array<string>, c array<string>")
    text = one.select(relations.element_context(F.col("d"), F.col("r"), F.col("c"))).first()[0]
    assert text == "Current description: d | Relationships: " + ", ".join(["r"] * 10)


def test_contexts(spark):
    big = spark.createDataFrame([(1, "x" * 900), (2, "y")], "k int, line string")
    assert contexts.entity_rows(big, 10).count() == 2 and contexts.entity_rows(big, 229).count() == 1
    assert contexts.hybrid_content([], []) == "No content available"
    got = contexts.hybrid_content(["c"], [{"title": "T", "summary": "s", "level": 1}, {"summary": ""}, {"summary": "u", "level": 0}])
    assert got == "=== Retrieved Text Chunks ===\n\nc\n\n\n=== Community Context (Hierarchical Summaries) ===\n\n[Level 1] T: s\n\n u"
    assert contexts.shares(8000) == (2000, 4000, 2000) and contexts.reduce_text([]) == contexts.NOTHING_KNOWN
    with pytest.raises(ValueError):
        contexts.shares(10, 0.6, 0.5)
    text = f"{contexts.ENTITIES}\n id entity description\nE_1 P_marie_curie a chemist\nand physicist\n{contexts.REPORTS}\nCommunity: One\nContent:\n{'z' * 310}\nCommunity: Two\nnothing"
    bare = f"{contexts.ENTITIES}\n nothing\nhere {contexts.REPORTS}"
    out, *others = [r[0] for r in spark.createDataFrame([(x,) for x in (text, "plain  text", None, bare, contexts.REPORTS)], "t string").select(contexts.plain_sentences("t")).collect()]
    assert "marie curie: a chemist and physicist" in out and out.endswith("z" * 300 + "...")
    assert others == ["plain  text", None, "nothing here", contexts.REPORTS]
    two = f"x\n{contexts.ENTITIES}\nid entity description\nA_1 ada_lovelace wrote notes\n  B_2 X_the_engine was never built  \n{contexts.REPORTS}\nCommunity: One\nContent: head\nfirst line\n second line\n"
    (said,) = spark.createDataFrame([(two,)], "t string").select(contexts.plain_sentences("t")).first()
    assert said == "Relevant entities and services: lovelace: wrote notes. the engine: was never built\n\nContext summaries: first line second line"


QUESTIONS = [("q1", "bridge", "?", "a", ["A", "B"]), ("q2", "bridge", "?", "long answer", ["A"]), ("q3", "comparison", "?", "c", ["C"]), ("q4", "bridge", "?", "d", [])]


def test_question_selection(spark, tmp_path):
    q = spark.createDataFrame(QUESTIONS, "id string, type string, question string, answer string, supporting array<string>").withColumn("context", F.array().cast("array<string>"))
    titles = lambda *x: spark.createDataFrame([(t,) for t in x], "title string")
    a = {r.id: (r.coverage, r.answerable) for r in evaluate.answerable(q, titles("A")).collect()}
    assert a == {"q1": (0.5, False), "q2": (1.0, True), "q3": (0.0, False), "q4": (0.0, True)}
    assert [r.id for r in evaluate.newly_answerable(q, titles("A"), titles("B")).collect()] == ["q1"]
    assert {(r.kind, r.id) for r in evaluate.by_difficulty(q, titles("A", "B")).collect()} == {("easy", "q1"), ("harder", "q2")}
    assert {(r.kind, r.id) for r in evaluate.by_difficulty(q, titles("A", "C")).collect()} == {("easy", "q2"), ("hard", "q3")}
    ids = spark.createDataFrame([("q3",), ("q1",)], "id string")
    assert evaluate.selected_questions(q, [("stored", "ids", ids.limit(0)), ("file", "ids", ids)], 1)[1].first()["id"] == "q1"
    name, chosen = evaluate.selected_questions(q, [("stored", "ids", None), ("manifest", "titles", titles("C"))])
    assert name == "manifest" and [r.id for r in chosen.collect()] == ["q3"]
    out = evaluate.testable_command(spark, q, titles("A", "B"), str(tmp_path), "2026-01-01")
    assert (out["testable"], out["coverage"]) == (2, 50.0) and readers.read_state(spark, str(tmp_path / "testable"), "id string, at string").count() == 2


def test_scores_and_comparison(spark):
    qs = [{"question": "who ?", "answer": "Ann"}, {"question": "where ?", "answer": "Rome"}]
    rows = evaluate.collected(qs, {"good": lambda q: {"final_answer": "ann" if "who" in q else "rome", "retrieval_details": [{"content": "Ann in Rome"}], "error": None}, "bad": lambda q: {"error": "down"}, "mute": lambda q: {"final_answer": ""}})
    records = spark.createDataFrame(rows, evaluate.RECORD)
    assert records.filter("error is not null").select("retrieved_contexts").first()[0] == [evaluate.FAILED]
    assert records.filter("approach = 'mute'").first()["retrieved_contexts"] == [evaluate.NO_CONTEXT]
    s = evaluate.summary(evaluate.judged(records, Settings()))
    got = {r.approach: r for r in s.collect()}
    assert (got["good"].f1, got["good"].exact_match, got["good"].context_recall, got["good"].success_rate) == (1, 1, 1, 1) and got["bad"].success_rate == got["bad"].f1 == 0
    assert {(r.metric, r.winner) for r in evaluate.compared(s).collect() if r.metric == "f1"} == {("f1", "good")}
    assert len(evaluate.answers_side_by_side(records).first()["answers"]) == 3
