"""Questions to Spark SQL: a read-only guard, verification, rule corrections, a refinement loop, agent tools."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.jsonrepair import balanced
from quillgraph.functions.tables import registered
from quillgraph.plans.retrieve import retriever

#: Misspelt keywords and what they should be. Fixed values.
TYPOS = {"SELCT": "SELECT", "SELECTS": "SELECT", "FORM": "FROM", "WHERES": "WHERE", "GROUPBY": "GROUP BY", "ORDERBY": "ORDER BY", "LIMTI": "LIMIT"}


@dataclass
class Verdict:
    valid: bool
    stage: str
    issues: list[str] = field(default_factory=list)


def _bare(text: str) -> str:
    """The query without string literals and comments."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)


def read_only(text: str) -> bool:
    """Whether the statement only reads, by its first word outside literals; one statement only."""
    bare = _bare(text).strip().rstrip(";").strip()
    return bool(re.match(r"(?i)(select|with|values|table|from)\b", bare)) and ";" not in bare and not re.search(r"(?i)\b(insert|create|drop|alter|delete|update|merge|truncate|refresh|cache)\s+(into|overwrite|table|view|from|database|or)\b", bare)


#: Patterns of a broken query outside its strings, and what they mean. Fixed values.
BROKEN = (
    (r"^\s*$", "empty query"),
    (r"(?i)\bselect\s+from\b", "nothing is selected"),
    (r"(?i)\bfrom\s*(where|group|order|limit|$)", "a table is missing"),
    (r"(?i)\b(where|and|or|on|by)\s*$", "a condition is missing at the end"),
    (r"(?i)\bwhere\s+(group|order|limit)\b", "a condition is missing"),
    (r"(?i),\s*(from|where|group|order|limit)\b", "a comma before a keyword"),
    (r"(?i)\bin\s*\(\s*\)", "an empty list"),
    (r"==|<>\s*null|=\s*null", "a comparison that is no SQL or never true"),
)


def check_syntax(text: str) -> Verdict:
    """Rules that need no engine: balanced brackets, a read-only start, patterns that are always wrong."""
    bare = _bare(text).strip().rstrip(";")
    issues = [x for x in [balanced(text)] if x]
    if bare and not read_only(text):
        issues.append("not a read-only statement")
    elif bare and not re.search(r"(?i)\b(select|from|values|table)\b", bare):
        issues.append("nothing is selected")
    issues += [said for pattern, said in BROKEN if re.search(pattern, bare)]
    return Verdict(not issues, "syntax", issues)


def check_plan(spark: SparkSession, text: str) -> Verdict:
    """Analysis without running it; the class of the error is the first issue."""
    try:
        _ = spark.sql(text.strip().rstrip(";")).schema
        return Verdict(True, "plan")
    except (ParseException, AnalysisException) as e:
        return Verdict(False, "plan", [type(e).__name__, e.getCondition() or "", str(e).splitlines()[0][:300]])


def verify(spark: SparkSession, text: str, judge: Callable[[str], Verdict] | None = None) -> Verdict:
    """Syntax, plan and the judge if there is one, until the first that fails."""
    for step in (lambda: check_syntax(text), lambda: check_plan(spark, text), *([lambda: judge(text)] if judge else [])):
        verdict = step()
        if not verdict.valid:
            return verdict
    return verdict


def corrected(text: str, issues: tuple[str, ...] = ()) -> str:
    """Rule corrections: fences, white space, a trailing semicolon, misspelt keywords, commas before keywords,
    comparisons, and what the verdict's issues hint at."""
    text = re.sub(r"^```\w*\s*|\s*```$", "", text.strip())
    text = re.sub(r"[ \t]+", " ", text).rstrip("; \n")
    for wrong, right in TYPOS.items():
        text = re.sub(rf"\b{wrong}\b", right, text, flags=re.I)
    text = re.sub(r",\s*(?=(?:from|where|group|order|limit)\b)", " ", text, flags=re.I)
    text = re.sub(r"\s*(?:==|=)\s*null\b", " IS NULL", text, flags=re.I)
    text = re.sub(r"\s*(?:<>|!=)\s*null\b", " IS NOT NULL", text, flags=re.I)
    text = re.sub(r"(?<![<>=!])==(?!=)", "=", text)
    if "nothing is selected" in issues:
        text = re.sub(r"(?i)\bselect\s+from\b", "SELECT * FROM", text)
    return re.sub(r"(?i)\s+(?:where|and|or)\s*$", "", text)


def refine(spark: SparkSession, text: str, most: int = 3, model: Callable[[str, Verdict], str] | None = None) -> tuple[str, Verdict, list[str]]:
    """Verify and correct up to `most` times; stops when valid or unchanged. The attempts, last one first out."""
    attempts = [text]
    verdict = verify(spark, text)
    while not verdict.valid and len(attempts) <= most:
        new = corrected(attempts[-1], tuple(verdict.issues))
        if new == attempts[-1] and model:
            new = model(attempts[-1], verdict)
        if new == attempts[-1]:
            break
        attempts.append(new)
        verdict = verify(spark, new)
    return attempts[-1], verdict, attempts


def run_capped(spark: SparkSession, text: str, most: int = 50) -> tuple[list[dict], str]:
    """Up to `most` rows of a read-only query, and a note if there are more."""
    if not read_only(text):
        raise PermissionError("only read-only statements are allowed")
    rows = [r.asDict() for r in spark.sql(text.strip().rstrip(";")).limit(most + 1).collect()]
    return rows[:most], f"... more than {most} rows" if len(rows) > most else ""


def schema_text(spark: SparkSession, tables: dict[str, DataFrame], most: int = 30, columns: int = 10) -> str:
    """Tables with row counts, their first columns and an example row's values, and at most `most` column names in
    all, for a prompt."""
    lines, names = [], []
    for name, df in sorted(tables.items()):
        shown = df.dtypes[:columns]
        first = df.select(*[F.left(F.col(f"`{c}`").cast("string"), F.lit(30)).alias(c) for c, _ in shown]).limit(1).collect()
        example = f" e.g. {', '.join(f'{c}={first[0][c]}' for c, _ in shown)}" if first else ""
        lines.append(f"{name} ({df.count()} rows): " + ", ".join(f"{c} {k}" for c, k in shown) + example)
        names += [c for c, _ in df.dtypes if c not in names]
    return "\n".join([*lines, "columns: " + ", ".join(sorted(names)[:most])])


def functions_by_prefix(spark: SparkSession, most: int = 10) -> DataFrame:
    """The function catalogue, grouped by first name segment, `most` of each group."""
    from pyspark.sql import Window

    f = spark.sql("SHOW FUNCTIONS").select("function", F.split_part("function", F.lit("_"), F.lit(1)).alias("grp"))
    k = F.row_number().over(Window.partitionBy("grp").orderBy("function"))
    return f.withColumn("k", k).filter(F.col("k") <= most).select("grp", "function")


#: Kinds of questions, the words that tell them, and their query; first match counts. Fixed values.
KINDS = (
    ("count", ("how many", "number of", "count of"), "SELECT count(*) AS n FROM {table}"),
    ("most", ("most frequent", "most mentioned", "most connected", "top "), "SELECT primary AS id, count(DISTINCT chunk_id) AS n FROM mentions GROUP BY primary ORDER BY n DESC, id LIMIT 10"),
    ("neighbours", ("connected to", "related to", "linked to", "neighbours of", "neighbors of"), "SELECT a, b, n FROM edges WHERE {ends} ORDER BY n DESC, a, b LIMIT 20"),
    ("kinds", ("what types", "which types", "kinds of", "which labels"), "SELECT kind, count(*) AS n FROM entities GROUP BY kind ORDER BY n DESC, kind"),
    ("sources", ("which document", "which documents", "where is", "mentioned in"), "SELECT DISTINCT doc_id FROM mentions WHERE {names} ORDER BY doc_id LIMIT 20"),
    ("passages", ("passage", "quote", "what does the text", "context of"), "SELECT chunk_id, left(text, 300) AS text FROM chunks WHERE {texts} ORDER BY chunk_id LIMIT 5"),
    ("reports", ("communit", "topics", "themes", "summar"), "SELECT community, title, summary FROM reports ORDER BY level DESC, rank DESC, community LIMIT 10"),
)


def drafted(question: str) -> str:
    """Offline generation: the query of the question's kind, else entities by name."""
    low = question.lower()
    table = next((w for w in ("chunks", "entities", "mentions", "edges", "reports", "documents") if w[:-1] in low), "entities")
    skip = {"what", "which", "known", "about", "with", "does", "where", "many", "most", "connected", "related", "linked", "mentioned", "document", "documents", "passage", "passages", "text", "neighbours"}
    words = [w for w in re.findall(r"\w{4,}", low) if w not in skip]
    likes = lambda c: " OR ".join(f"lower({c}) LIKE '%{w}%'" for w in words) or "true"
    for _, told, query in KINDS:
        if any(w in low for w in told):
            return query.format(table=table, ends=f"{likes('a')} OR {likes('b')}", names=likes("name"), texts=likes("text"))
    return f"SELECT id, name FROM entities WHERE {likes('name')} ORDER BY id LIMIT 20"


@retriever("text2query")
def text2query(graph, question, settings, generate: Callable[[str], str] = drafted, most: int = 3):
    spark = graph["chunks"].sparkSession
    registered(spark)
    for name, df in graph.items():
        df.createOrReplaceTempView(name)
    text, verdict, attempts = refine(spark, generate(question), most)
    if not verdict.valid:
        return f"No valid query: {'; '.join(verdict.issues)}", []
    rows, note = run_capped(spark, text)
    details = [{"content": ", ".join(f"{k}={v}" for k, v in r.items()), "score": 1.0, "metadata": {"id": str(i), "query": text}} for i, r in enumerate(rows)]
    return settings.model(f"{question}\n\n" + "\n".join(d["content"] for d in details) + note), details


@retriever("agent")
def agent(graph, question, settings, generate: Callable[[str], str] | None = None, iterations: int = 5):
    """The tool loop: a generator sees the question below the schema, its query is run; if nothing comes back, the
    question is broadened. Bounded by `iterations`. Without a generator, the offline draft needs no schema."""
    from quillgraph.plans.retrieve import ask

    spark = graph["chunks"].sparkSession
    schema = schema_text(spark, {n: graph[n] for n in ("entities", "chunks", "mentions", "edges", "reports") if n in graph}) if generate else ""
    draft = (lambda q: generate(f"{schema}\n\n{q}")) if generate else drafted
    found, asked = None, question
    for _ in range(max(1, iterations)):
        found = ask("text2query", graph, asked, settings, generate=draft)
        broader = " ".join(asked.split()[:-1])
        if found["retrieval_details"] or not broader:
            break
        asked = broader
    if found["error"]:
        raise RuntimeError(found["error"])
    return found["final_answer"], found["retrieval_details"]


def tools(graph: dict[str, DataFrame]) -> dict[str, Callable[[str], str]]:
    """What an agent framework may call: the schema and a read-only query, both text to text."""
    spark = next(iter(graph.values())).sparkSession
    registered(spark)
    for name, df in graph.items():
        df.createOrReplaceTempView(name)

    def read(query: str) -> str:
        rows, note = run_capped(spark, query)
        return "\n".join([", ".join(f"{k}={v}" for k, v in r.items()) for r in rows] + ([note] if note else []))

    return {"get_schema": lambda _="": schema_text(spark, graph), "read_query": read}
