"""Sources and sinks: question sets, benchmarks, PDFs, latency rows, corpus caches, state tables, reports."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.storage import upserted

QUESTION = "_id string, id string, question string, answer string, type string, level string, supporting_facts array<array<string>>, context array<struct<title string, sentences array<string>>>"
PERF = "query string, impl string, strategy string, cold_start boolean, success boolean, init_ms double, query_ms double, total_ms double, event string, run_idx int"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions: one id whatever its name, unknown types and levels, facts as titles."""
    raw = spark.read.schema("_id string, id string, question string, answer string, type string, level string, supporting_facts array<array<string>>, context array<array<string>>").option("multiLine", True).json(path)
    return raw.select(
        F.coalesce("_id", "id").alias("id"), "question", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("level", F.lit("unknown")).alias("level"),
        F.transform(F.coalesce("supporting_facts", F.array().cast("array<array<string>>")), lambda f: f[0]).alias("supporting"), F.transform(F.coalesce("context", F.array().cast("array<array<string>>")), lambda c: c[0]).alias("context"),
    )


def referenced_titles(q: DataFrame) -> DataFrame:
    return q.select(F.explode(F.array_union("context", "supporting")).alias("title")).filter(F.length(F.trim("title")) > 0).distinct()


def testable(q: DataFrame, known: DataFrame, scope: str = "supporting") -> DataFrame:
    """Questions all of whose titles (`supporting`, or `all`) are known, and have any."""
    titles = F.array_distinct("supporting" if scope == "supporting" else F.array_union("context", "supporting"))
    each = q.select("id", F.explode_outer(titles).alias("title")).join(known.select("title", F.lit(1).alias("known")).distinct(), "title", "left")
    sums = each.groupBy("id").agg(F.count("title").alias("needed"), F.count("known").alias("found"))
    return sums.filter("needed > 0 and needed = found").select("id")


def benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", ";").option("header", True).csv(path).select("question", "ground_truth")


def benchmark_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Malformed lines are left out."""
    schema = "question string, ground_truth string, record_id string, source_dataset string, domain string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter("question is not null")


def perf_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(PERF).option("multiLine", True).json(path)
    return rows.filter(F.coalesce(F.col("event") != "warm_retriever_init", F.lit(True))).drop("event")


def pdf_documents(spark: SparkSession, path: str, parse: Callable[[bytes], str] | None = None, limit: int | None = None) -> DataFrame:
    """doc_id (path), name, text of PDF files, pages joined by line feeds; blank and broken ones have an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.lower("path").endswith(".pdf"))
    files = files.orderBy("path").limit(limit) if limit else files

    def run(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    text = (parse or _pdf_text)(bytes(content))
                    rows.append((p, p.rsplit("/", 1)[-1], text, None if text.strip() else "no text"))
                except Exception as e:
                    rows.append((p, p.rsplit("/", 1)[-1], None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["doc_id", "name", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, name string, text string, error string")


def _pdf_text(data: bytes) -> str:
    import io

    from pypdf import PdfReader  # optional: only where PDFs are read

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def tables_as_chunks(tables: DataFrame, start: DataFrame, most: int = 20_000) -> DataFrame:
    """Table texts (doc_id, csv) as chunks of type `table`, at most `most` characters, numbered on after the text."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("csv"))
    return tables.withColumn("k", k).join(start, "doc_id", "left").select("doc_id", (F.coalesce("chunks", F.lit(0)) + F.col("k") - 1).alias("index"), F.left("csv", F.lit(most)).alias("text"), F.lit("table").alias("type"))


def pdf_tables(spark: SparkSession, path: str, extractors: list[Callable[[bytes], list[str]]], start: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, index, text, type: tables of PDF files as chunks after a document's text chunks (start: doc_id, chunks).

    extractors: bytes to tables as CSV texts, in order of preference; the first that finds any counts, one that
    fails counts as finding none. Which library they use is up to the caller.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.lower("path").endswith(".pdf"))

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                found: list[str] = []
                for extract in extractors:
                    try:
                        found = [x for x in extract(bytes(content)) if x.strip()]
                    except Exception:  # another library may read what this one can't
                        found = []
                    if found:
                        break
                if found:
                    yield pd.DataFrame({"doc_id": p, "csv": found})

    return tables_as_chunks(files.select("path", "content").mapInPandas(run, "doc_id string, csv string"), start, most)


def fetched_articles(titles: DataFrame, fetch: Callable[[str], dict | None], cache: str, at_once: int = 4) -> DataFrame:
    """name, title, text, url, summary of titles (title): from the cache at `cache`, or fetched and added to it.

    `fetch` gives a dict or null; a title that fails isn't cached, so that another run tries it again.
    """
    spark = titles.sparkSession
    schema = "name string, title string, text string, url string, summary string"
    _, there = _exists(spark, cache)
    known = spark.read.schema(schema).parquet(cache) if there else spark.createDataFrame([], schema)
    wanted = titles.select("title").filter(F.length(F.trim("title")) > 0).distinct().withColumn("name", cache_name(F.col("title")))

    def one(title: str):
        try:
            return fetch(title)
        except Exception:
            return None

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                rows = [(n, t, a.get("text"), a.get("url"), (a.get("summary") or "")[:500]) for n, t, a in zip(pdf["name"], pdf["title"], pool.map(one, pdf["title"])) if a]
                yield pd.DataFrame(rows, columns=["name", "title", "text", "url", "summary"])

    wanted.join(known.select("name"), "name", "left_anti").select("name", "title").mapInPandas(run, schema).write.mode("append").parquet(cache)
    return spark.read.schema(schema).parquet(cache).join(wanted.select("name"), "name", "left_semi")


def cache_name(title: Column) -> Column:
    """A file name for a title: safe characters, at most 50, and 12 digits of its MD5."""
    safe = F.left(F.regexp_replace(title, "[^0-9A-Za-z]", "_"), F.lit(50))
    return F.concat_ws("_", safe, F.left(F.md5(title.cast("binary")), F.lit(12)))


def save_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ---- state tables: folders of rows, and a log of numbered commits that each name one


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _commits(spark: SparkSession, path: str) -> list[int]:
    """The numbers in a state's log, ascending."""
    fs, log = _fs(spark, f"{path}/log")
    return sorted(int(n) for s in fs.listStatus(log) if (n := s.getPath().getName()).isdigit()) if fs.exists(log) else []


def _named(spark: SparkSession, path: str, number: int) -> str:
    """The folder that a commit names."""
    fs, where = _fs(spark, f"{path}/log/{number:012d}")
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put_if_absent(spark: SparkSession, path: str, number: int, text: str) -> bool:
    """Commit `number` with its text, whole or not at all; False if that number is taken."""
    fs, target = _fs(spark, f"{path}/log/{number:012d}")
    _, draft = _fs(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(text.encode())
    out.close()
    fs.mkdirs(target.getParent())
    if fs.getScheme() != "file":
        return fs.rename(draft, target)  # a file is not renamed over another
    try:  # on one machine a rename would replace the file; a link doesn't
        os.link(draft.toUri().getPath(), target.toUri().getPath())
    except FileExistsError:
        return False
    finally:
        fs.delete(draft, False)
    return True


def read_state(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """A keyed state table as its newest commit, or the one numbered `version`, has it; empty where there is none.

    What is read stays as it is while others write. The newest commit and the one before can be read.
    """
    commits = _commits(spark, path)
    if not commits:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{_named(spark, path, commits[-1] if version is None else version)}")


def _changed(spark: SparkSession, path: str, schema: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The state after `change`, committed under the next number.

    Rows are written first; whoever puts the next number into the log has the commit. Others find it taken, make
    their change to the new state and try again, so no writer's change is lost. A crash leaves the state before.
    """
    while True:
        commits = _commits(spark, path)
        base = spark.read.schema(schema).parquet(f"{path}/{_named(spark, path, commits[-1])}") if commits else spark.createDataFrame([], schema)
        df, name = change(base), f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{name}")
        number = commits[-1] + 1 if commits else 0
        if _put_if_absent(spark, path, number, name):
            for old in commits[-2:-1]:  # the one before the last; the last may still be read
                fs, where = _fs(spark, f"{path}/{_named(spark, path, old)}")
                fs.delete(where, True)
            return spark.read.schema(df.schema).parquet(f"{path}/{name}")
        fs, where = _fs(spark, f"{path}/{name}")
        fs.delete(where, True)


def write_state(spark: SparkSession, path: str, new: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert by key; until the commit is there, readers and a crash find the state before."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new.schema.fields)
    return _changed(spark, path, schema, lambda base: upserted(base, new, key, order))


def delete_state(spark: SparkSession, path: str, schema: str, key: str | None = None, values: list | None = None) -> DataFrame:
    """The state without the rows of some keys, or without any."""
    return _changed(spark, path, schema, lambda base: base.filter(~F.col(key).isin(values)) if key and values else base.limit(0))


# ---- the vector store: a table of texts with metadata and vectors


def build_store(chunks: DataFrame, path: str) -> DataFrame:
    """chunks (chunk_id, text, embedding and metadata) as the store at `path`, whatever was there before."""
    chunks.write.mode("overwrite").parquet(path)
    return chunks.sparkSession.read.parquet(path)


def store_size(spark: SparkSession, path: str) -> int:
    """Rows of a store; 0 where there is none."""
    _, there = _exists(spark, path)
    return spark.read.parquet(path).count() if there else 0


def _exists(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.exists(where)


def wiped(spark: SparkSession, root: str, names: list[str]) -> dict[str, int]:
    """Tables `names` below `root` removed; what is left of each, 0 if all went well."""
    for name in names:
        fs, there = _exists(spark, f"{root}/{name}")
        if there:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}"), True)
    return {name: store_size(spark, f"{root}/{name}") for name in names}


def schema_problems(tables: dict[str, DataFrame], expected: dict[str, list[str]], keys: dict[str, str], dim: int) -> list[str]:
    """What constraints and indexes would have found: missing tables and columns, repeated keys, wrong vectors."""
    out = []
    for name, columns in sorted(expected.items()):
        if name not in tables:
            out.append(f"{name}: missing")
            continue
        df = tables[name]
        out += [f"{name}.{c}: missing" for c in columns if c not in df.columns]
        key = keys.get(name)
        if key in df.columns and unique_violations(df, key).take(1):
            out.append(f"{name}.{key}: not unique")
        if "embedding" in df.columns and wrong_dimensions(df, dim).take(1):
            out.append(f"{name}.embedding: not of {dim} numbers")
    return out


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: what a uniqueness constraint would reject."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def wrong_dimensions(df: DataFrame, dim: int) -> DataFrame:
    return df.filter(F.size("embedding") != dim)


def write_results(df: DataFrame, path: str) -> None:
    """Results as one CSV folder and one JSON folder per run."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


def write_run(scored: DataFrame, summary: DataFrame, comparison: DataFrame, root: str, at: str | None = None) -> str:
    """A run's folder, named by its time: details by approach as CSV, the comparison as CSV, metrics as JSON."""
    import datetime

    path = f"{root}/run_{at or datetime.datetime.now(datetime.UTC).strftime('%Y%m%d_%H%M%S')}"
    flat = scored.withColumn("retrieved_contexts", F.to_json("retrieved_contexts"))
    flat.write.mode("overwrite").partitionBy("approach").option("header", True).csv(f"{path}/details")
    comparison.write.mode("overwrite").option("header", True).csv(f"{path}/comparison")
    summary.write.mode("overwrite").json(f"{path}/metrics")
    return path


def latency_report(rows: DataFrame) -> str:
    """A Markdown table of percentiles by implementation; a handful of rows."""
    q = lambda p: F.percentile("total_ms", F.lit(p))
    by = rows.groupBy("impl").agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.count_if("success").alias("ok")).orderBy("impl").collect()
    head = "| implementation | runs | successes | p50 ms | p95 ms |\n| - | - | - | - | - |"
    return "\n".join([head, *(f"| {r['impl']} | {r['n']} | {r['ok']} | {r['p50']:.1f} | {r['p95']:.1f} |" for r in by)])


def title_of(name: str) -> str:
    """The title in a document name `prefix_title_words_index`."""
    return re.sub(r"^[^_]*_|_[^_]*$", "", name)
