"""Evaluation: which questions can be asked, answers of several approaches, scores, comparison, five phases."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.models import PRESETS, Settings
from quillgraph.plans.contexts import plain_sentences
from quillgraph.sources import readers

#: What an answer's contexts are when there are none, and when its retriever failed. Fixed values.
NO_CONTEXT, FAILED = "No context retrieved", "Error: Could not retrieve context"
RECORD = "approach string, user_input string, question string, retrieved_contexts array<string>, response string, reference string, ground_truth string, error string"


def answerable(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """id, type, needed, found, coverage, answerable: by the titles a question's facts need, of those ingested."""
    each = questions.select("id", "type", F.explode_outer(F.array_distinct("supporting")).alias("title"))
    hit = each.join(titles.select("title", F.lit(1).alias("known")).distinct(), "title", "left")
    g = hit.groupBy("id", "type").agg(F.count("title").alias("needed"), F.count("known").alias("found"))
    return g.select("id", "type", "needed", "found", F.coalesce(F.try_divide("found", "needed"), F.lit(0.0)).alias("coverage"), (F.col("needed") == F.col("found")).alias("answerable"))


def newly_answerable(questions: DataFrame, before: DataFrame, batch: DataFrame) -> DataFrame:
    """id of questions that a batch of titles completes: all needed are known now, and not all were before.

    Only questions that need a title of the batch are looked at.
    """
    touched = questions.select("id", F.explode("supporting").alias("title")).join(batch.select("title").distinct(), "title", "left_semi").select("id").distinct()
    some = questions.join(touched, "id", "left_semi")
    now = readers.testable(some, before.select("title").unionByName(batch.select("title")))
    return now.join(readers.testable(some, before), "id", "left_anti")


def by_difficulty(questions: DataFrame, titles: DataFrame, each: int = 3) -> DataFrame:
    """kind, id, question, answer: the first answerable bridge question is easy, comparisons are hard; without a
    comparison the one with the longest answer is."""
    a = questions.join(answerable(questions, titles).filter("answerable").select("id"), "id", "left_semi").select("id", "type", "question", "answer")
    easy = a.filter("type = 'bridge'").orderBy("id").limit(1).withColumn("kind", F.lit("easy"))
    hard = a.filter("type = 'comparison'").orderBy("id").limit(1 + each).withColumn("kind", F.lit("hard"))
    longest = a.orderBy(F.desc(F.length("answer")), "id").limit(1).withColumn("kind", F.lit("harder"))
    longest = longest.join(hard.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")).drop("n")  # one row or none, both sides
    return easy.unionByName(hard).unionByName(longest).select("kind", "id", "question", "answer")


def selected_questions(questions: DataFrame, sources: list[tuple[str, str, DataFrame | None]], most: int | None = None) -> tuple[str, DataFrame]:
    """(source, questions): by the first source that has rows.

    sources: (name, `ids` or `titles`, table) by priority: computed ids, a file of ids, the manifest's titles, the
    progress's titles, the stored documents' titles. Without any, all questions. The limit comes last, by id.
    """
    cut = lambda q: q.orderBy("id").limit(most) if most else q
    for name, kind, table in sources:
        if table is None or not table.take(1):
            continue
        if kind == "ids":
            return name, cut(questions.join(table.select("id").distinct(), "id", "left_semi"))
        known = readers.testable(questions, table)
        return name, cut(questions.join(known, "id", "left_semi"))
    return "all", cut(questions)


def collected(questions: list[dict], approaches: dict[str, Callable[[str], dict]]) -> list[tuple]:
    """One record per approach and question; an approach that fails leaves a record of its error."""
    out = []
    for approach, ask in approaches.items():
        for q in questions:
            try:
                got = ask(q["question"])
                if got.get("error"):
                    raise RuntimeError(got["error"])
                contexts = [str(d["content"] if isinstance(d, dict) else d) for d in got.get("retrieval_details") or []] or [NO_CONTEXT]
                out.append((approach, q["question"], q["question"], contexts, str(got.get("final_answer", "")), q["answer"], q["answer"], None))
            except Exception as e:
                out.append((approach, q["question"], q["question"], [FAILED], f"Error: {e}", q["answer"], q["answer"], str(e)))
    return out


def judged(records: DataFrame, settings: Settings) -> DataFrame:
    """records with response_relevancy, factual_correctness, semantic_similarity, exact_match, f1, context_recall.

    Offline judges: cosine of the answer with the question and with the reference, token F1 for correctness.
    Failed records score 0.
    """
    vector = lambda c: settings.embedder.column(F.col(c))
    ok = F.col("error").isNull()
    score = lambda x: F.when(ok, F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0)))).otherwise(0.0)
    wide = records.withColumns({"_q": vector("question"), "_a": vector("response"), "_r": vector("reference"), "_short": C.short_answer(F.col("response"))})
    context = F.array_join(F.transform("retrieved_contexts", plain_sentences), " ")
    out = {
        "response_relevancy": score(C.cosine("_a", "_q")),
        "factual_correctness": score(C.token_f1(F.col("response"), F.col("reference"))),
        "semantic_similarity": score(C.cosine("_a", "_r")),
        "exact_match": score(C.exact_match(F.col("_short"), F.col("reference"))),
        "f1": score(C.token_f1(F.col("_short"), F.col("reference"))),
        "context_recall": score(C.context_recall(F.col("reference"), context)),
    }
    return wide.withColumns(out).drop("_q", "_a", "_r", "_short")


METRICS = ("response_relevancy", "factual_correctness", "semantic_similarity", "exact_match", "f1", "context_recall")


def summary(scored: DataFrame) -> DataFrame:
    """approach, n, success_rate and the mean of each metric."""
    mean = lambda m: F.round(F.avg(F.nullif(m, F.lit(float("nan")))), 4).alias(m)
    return scored.groupBy("approach").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("error").isNull()) / F.count(F.lit(1)), 4).alias("success_rate"), *[mean(m) for m in METRICS])


def compared(summaries: DataFrame) -> DataFrame:
    """metric, approach, value, winner: who has the highest mean, ties to the first name."""
    from pyspark.sql import Window

    long = summaries.unpivot("approach", list(METRICS), "metric", "value")
    first = F.first("approach").over(Window.partitionBy("metric").orderBy(F.desc("value"), "approach"))
    return long.withColumn("winner", first).select("metric", "approach", "value", "winner")


def testable_command(spark: SparkSession, questions: DataFrame, titles: DataFrame, path: str, at: str) -> dict:
    """Compute the testable questions, keep them as the current state and as a JSON file; counts come back."""
    found = readers.testable(questions, titles)
    total, n = questions.count(), found.count()
    readers.write_state(spark, f"{path}/testable", found.withColumn("at", F.lit(at)), "id", "at")
    found.orderBy("id").coalesce(1).write.mode("overwrite").json(f"{path}/testable_json")
    return {"total": total, "testable": n, "coverage": round(100.0 * n / total, 1) if total else 0.0, "computed_at": at}


def run_benchmark(spark: SparkSession, questions: DataFrame, graph: dict, approaches: list[str], preset: str = "micro", sources: list | None = None, path: str | None = None, settings: Settings | None = None) -> dict:
    """Five phases: choose questions, collect answers, score them, compare, write; with the seconds of each.

    A preset bounds the questions, so that answers on the driver are bounded too.
    """
    from quillgraph.plans.retrieve import ask

    settings, took = settings or Settings(), {}

    def phase(name: str, run: Callable):
        began = time.monotonic()
        out = run()
        took[name] = round(time.monotonic() - began, 3)
        return out

    source, chosen = phase("questions", lambda: selected_questions(questions, sources or [], PRESETS[preset][0]))
    rows = [r.asDict() for r in chosen.select("id", "question", "answer").collect()]
    asked = {a: (lambda q, a=a: ask(a, graph, q, settings)) for a in approaches}
    records = phase("answers", lambda: spark.createDataFrame(collected(rows, asked), RECORD))
    scored = phase("scores", lambda: judged(records, settings))
    table = phase("comparison", lambda: summary(scored).collect())
    if path:
        phase("results", lambda: readers.write_run(scored, summary(scored), compared(summary(scored)), path))
    return {"source": source, "questions": len(rows), "summary": [r.asDict() for r in table], "seconds": took, "total_seconds": round(sum(took.values()), 3)}


def answers_side_by_side(records: DataFrame) -> DataFrame:
    """question, answers: what every approach answered, by its name."""
    return records.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("approach", "response"))).alias("answers"))


def latency_rows(graph: dict, questions: list[str], approaches: list[str], runs: int = 2, settings: Settings | None = None) -> list[dict]:
    """Latency of every approach and question, the first run cold; failures are rows too."""
    from quillgraph.plans.retrieve import ask

    out = []
    for run in range(runs):
        for a in approaches:
            for q in questions:
                r = ask(a, graph, q, settings)
                out.append({"query": q, "impl": a, "cold_start": run == 0, "run_idx": run, "success": r["error"] is None, "total_ms": r["performance_metrics"]["total_ms"]})
    return out
