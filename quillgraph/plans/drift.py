"""Iterative retrieval: a primer, follow-up actions ranked by score and degree, a final reduction.

The action graph is a few dozen rows on the driver; every search it asks for is a DataFrame plan.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import functions as F

from quillgraph.functions.columns import cosine
from quillgraph.functions.jsonrepair import repaired
from quillgraph.models import Settings, expanded, route
from quillgraph.plans.indexes import nearest
from quillgraph.plans.retrieve import ask, retriever


@dataclass
class Action:
    query: str
    depth: int = 0
    answer: str = ""
    score: float = float("-inf")
    complete: bool = False
    tokens: int = 0
    error: str = ""


@dataclass
class ActionGraph:
    actions: dict[str, Action] = field(default_factory=dict)
    edges: set[tuple[str, str]] = field(default_factory=set)

    def add(self, action: Action, parent: str | None = None) -> bool:
        """False if the query is known; the edge is kept either way, loops are not."""
        new = action.query not in self.actions
        if new:
            self.actions[action.query] = action
        if parent and parent != action.query:
            self.edges.add((parent, action.query))
        return new

    def degree(self, query: str) -> tuple[int, int]:
        return sum(b == query for _, b in self.edges), sum(a == query for a, _ in self.edges)

    def ranked(self, depth: int, most: int) -> list[Action]:
        """Open actions down to a depth, by score + 5 in-degree + 2 out-degree, then by query."""
        open_ = [a for a in self.actions.values() if not a.complete and a.depth <= depth]
        value = lambda a: max(a.score, -1e9) + 5 * self.degree(a.query)[0] + 2 * self.degree(a.query)[1]
        return sorted(open_, key=lambda a: (-value(a), a.query))[:most]

    def path(self, start: str, end: str) -> list[str]:
        """A shortest chain of queries; empty if there is none."""
        before, todo = {start: ""}, deque([start])
        while todo:
            here = todo.popleft()
            if here == end:
                chain = [here]
                while before[chain[-1]]:
                    chain.append(before[chain[-1]])
                return chain[::-1]
            for a, b in sorted(self.edges):
                if a == here and b not in before:
                    before[b] = here
                    todo.append(b)
        return []

    def depth(self, query: str) -> int:
        """How many steps an action is from the first one; -1 if nothing leads to it."""
        chains = [c for c in (self.path(a.query, query) for a in self.actions.values() if a.depth == 0) if c]
        return min(map(len, chains)) - 1 if chains else -1

    def tokens(self) -> dict[str, int]:
        """Token totals of all actions."""
        done = [a for a in self.actions.values() if a.complete]
        return {"actions": len(self.actions), "completed": len(done), "total_tokens": sum(a.tokens for a in done)}

    def info(self, query: str) -> dict:
        a = self.actions[query]
        return asdict(a) | {"in_degree": self.degree(query)[0], "out_degree": self.degree(query)[1], "steps": self.depth(query)}

    def density(self) -> float:
        n = len(self.actions)
        return len(self.edges) / (n * (n - 1)) if n > 1 else 0.0

    def dump(self) -> dict:
        return {"actions": [asdict(a) for a in self.actions.values()], "edges": sorted(self.edges)}

    @classmethod
    def load(cls, data: dict) -> ActionGraph:
        return cls({a["query"]: Action(**a) for a in data["actions"]}, {tuple(e) for e in data["edges"]})


def primer_context(graph, k: int = 8):
    """The communities with the highest ranks and up to five of their members."""
    top = graph["reports"].orderBy(F.desc_nulls_first("rank"), F.desc("member_count"), "community").limit(k)
    names = graph["members"].join(F.broadcast(top.select("community")), "community").groupBy("community").agg(F.slice(F.array_sort(F.collect_list("node")), 1, 5).alias("ids"))
    rows = top.join(names, "community", "left").orderBy(F.desc_nulls_first("rank"), F.desc("member_count"), "community").collect()
    return "\n".join(f"{r['title']}: {r['summary']} [{', '.join(r['ids'] or [])}]" for r in rows)


def follow_ups(answer: str, question: str, most: int = 3) -> list[str]:
    """Offline follow-ups: the first named members of an answer, asked about."""
    names = [w.strip(" ,.[]") for w in answer.replace(",", " ").split() if "_" in w]
    return [f"What is known about {n}?" for n in dict.fromkeys(names) if n and n not in question][:most]


def primed(graph, question: str, settings: Settings, k: int = 8, most: int = 3) -> dict:
    """The primer: the question expanded by a hypothetical answer, the answer from the top communities, at most
    `most` follow-ups and a score from 0 to 100; null answers score 0."""
    context = primer_context(graph, k)
    wide = expanded(question, settings.model, context.split("\n")[0] if context else "")
    answer = settings.model(f"{question}\n\n{context}")
    return {"query": question, "expanded": wide, "answer": answer, "follow_ups": follow_ups(answer, question, most), "score": max(0.0, min(100.0, 50.0 if answer else 0.0)), "tokens": len(context) // 4}


def primed_all(graph, questions: list[str], settings: Settings, at_once: int = 3) -> tuple[list[dict], dict]:
    """Primers of several questions, a failed one with its error, and how they went."""

    def one(q: str) -> dict:
        try:
            return primed(graph, q, settings)
        except Exception as e:
            return {"query": q, "answer": "", "follow_ups": [], "score": 0.0, "tokens": 0, "error": str(e)}

    with ThreadPoolExecutor(at_once) as pool:
        out = list(pool.map(one, questions))
    failed = sum("error" in x for x in out)
    mean = sum(x["score"] for x in out) / len(out) if out else 0.0
    return out, {"questions": len(out), "failed": failed, "mean_score": mean}


def acted(graph, action: Action, settings: Settings, most: int = 3) -> tuple[Action, list[str]]:
    """The action done: routed, searched, scored by its evidence; its error is kept and scores 0."""
    found = ask("global" if route(action.query) == "GLOBAL" else "local", graph, action.query, settings)
    action.answer, action.complete, action.error = found["final_answer"], True, found["error"] or ""
    action.score = 0.0 if found["error"] else min(100.0, 10.0 * len(found["retrieval_details"]))
    action.tokens = sum(len(d["content"]) for d in found["retrieval_details"]) // 4
    return action, follow_ups(action.answer, action.query, most)


def explore(graph, question: str, settings: Settings, depth: int = 2, at_once: int = 3, k: int = 8) -> ActionGraph:
    state, first = ActionGraph(), primed(graph, question, settings, k)
    state.add(Action(question, 0, first["answer"], first["score"], True, first["tokens"]))
    for q in first["follow_ups"]:
        state.add(Action(q, 1, score=0.0), question)
    for level in range(1, depth + 1):
        todo = state.ranked(level, at_once)
        if not todo:
            break
        with ThreadPoolExecutor(at_once) as pool:
            for action, more in pool.map(lambda a: acted(graph, a, settings), todo):
                for q in more:
                    if q != question:
                        state.add(Action(q, level + 1, score=0.0), action.query)
    return state


def relevant_reports(graph, question: str, settings: Settings, k: int = 10):
    """Reports with a summary by cosine with the expanded question; ties by level, then rank."""
    wide = expanded(question, settings.model, primer_context(graph, 1))
    if "reports" in settings.indexes:  # as many as might tie with the last one, then the table's order
        best = nearest(graph, "reports", wide, settings, 2 * k).select(F.col("id").alias("community"), F.col("cosine").alias("similarity"))
        scored = graph["reports"].join(F.broadcast(best), "community")
        return scored.orderBy(F.desc("similarity"), "level", F.desc(F.coalesce("rank", F.lit(1))), "community").limit(k)
    spark = graph["reports"].sparkSession
    q = spark.createDataFrame([(wide,)], "text string").select(settings.embedder.column(F.col("text")).alias("q"))
    some = graph["reports"].filter(F.length("summary") > 0).withColumn("e", settings.embedder.column(F.col("summary")))
    scored = some.crossJoin(F.broadcast(q)).withColumn("similarity", cosine("e", "q")).drop("e", "q")
    return scored.orderBy(F.desc("similarity"), "level", F.desc(F.coalesce("rank", F.lit(1))), "community").limit(k)


def point_of(said: str) -> dict:
    """answer, score, follow_ups of a legacy action's JSON; plain words are the answer, with score 50."""
    found = repaired(said)
    data = json.loads(found) if found else None
    if not isinstance(data, dict):
        return {"answer": said, "score": 50.0, "follow_ups": []}
    try:
        score = float(data.get("score", 50))
    except (TypeError, ValueError):
        score = 50.0
    more = data.get("follow_up_queries") or data.get("follow_ups") or []
    return {"answer": str(data.get("response", data.get("answer", ""))), "score": score, "follow_ups": [str(x) for x in more] if isinstance(more, list) else []}


@retriever("legacy_drift")
def legacy_drift(graph, question, settings, depth: int = 2, at_once: int = 3, least: float = 20.0, most: int = 10, seed: int = 42):
    """The older path: reports by cosine first, open actions in a seeded random order, results of at least `least`,
    the best `most` of them."""
    reports = relevant_reports(graph, question, settings).collect()
    first = point_of(settings.model(f"{question}\n\n" + "\n".join(r["summary"] for r in reports)))
    state = ActionGraph()
    state.add(Action(question, 0, first["answer"], first["score"], True, sum(len(r["summary"]) for r in reports) // 4))
    for q in first["follow_ups"] or follow_ups(first["answer"], question):
        state.add(Action(q, 1, score=0.0), question)
    order = lambda a: hashlib.md5(f"{a.query}:{seed}".encode()).hexdigest()
    for level in range(1, depth + 1):
        todo = sorted((a for a in state.actions.values() if not a.complete and a.depth <= level), key=order)[:at_once]
        for action in todo:
            for q in acted(graph, action, settings)[1]:
                state.add(Action(q, level + 1, score=0.0), action.query)
    kept = sorted((a for a in state.actions.values() if a.complete and a.answer and a.score >= least), key=lambda a: (-a.score, a.query))[:most]
    details = [{"content": a.answer, "score": a.score, "metadata": {"id": a.query, "depth": a.depth}} for a in kept]
    if not kept:
        return "No answer was found.", details
    return settings.model(f"{question}\n\n" + "\n".join(a.answer for a in kept)) or kept[0].answer, details


def report_problems(reports) -> dict[str, int]:
    """Reports that an iterative search can't use: without content, without a vector, and the vectors' lengths."""
    has = "embedding" in reports.columns
    e = F.col("embedding") if has else F.lit(None).cast("array<double>")
    row = reports.agg(F.count_if(F.coalesce(F.length("summary"), F.lit(0)) == 0).alias("empty"), F.count_if(e.isNull() | (F.size(e) == 0)).alias("bare"), F.count_distinct(F.when(F.size(e) > 0, F.size(e))).alias("lengths")).first()
    return {"without_content": row["empty"], "without_vector": row["bare"], "vector_lengths": row["lengths"]}


def reduced(state: ActionGraph, question: str, settings: Settings, primer: bool = True) -> str:
    """The answers of completed actions, best first, made into one; the best alone if that is empty."""
    done = sorted((a for a in state.actions.values() if a.complete and a.answer and (primer or a.depth)), key=lambda a: (-a.score, a.query))
    if not done:
        return "No answer was found."
    return settings.model(f"{question}\n\n" + "\n".join(f"{i}. {a.answer}" for i, a in enumerate(done, 1))) or done[0].answer


@retriever("drift")
def drift(graph, question, settings, depth: int = 2, at_once: int = 3):
    state = explore(graph, question, settings, depth, at_once)
    details = [{"content": a.answer, "score": a.score, "metadata": {"id": a.query, "depth": a.depth}} for a in state.actions.values() if a.complete]
    return reduced(state, question, settings), details


def ranked_actions(actions, edges, most: int):
    """The ranking as a plan over tables actions (query, score, complete) and edges (src, dst)."""
    into = edges.groupBy(F.col("dst").alias("query")).agg(F.count(F.lit(1)).alias("i"))
    out = edges.groupBy(F.col("src").alias("query")).agg(F.count(F.lit(1)).alias("o"))
    value = F.col("score") + 5 * F.coalesce("i", F.lit(0)) + 2 * F.coalesce("o", F.lit(0))
    return actions.filter("not complete").join(into, "query", "left").join(out, "query", "left").withColumn("value", value).orderBy(F.desc("value"), "query").limit(most)


__all__ = ["Action", "ActionGraph", "drift", "explore", "primer_context", "ranked_actions", "reduced"]
