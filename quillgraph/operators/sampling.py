"""Corpus samples for label discovery: diverse, pattern-rich and mid-document parts under one character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.columns import rich_patterns_any, sample_key, text_units

#: Shares of the budget: diverse segments, patterns, random sentences. Fixed values.
SHARES = (0.4, 0.3, 0.3)


def seeded(seed: int, *cols: str | Column) -> Column:
    """A pseudorandom order that any engine can repeat: the MD5 of the key's parts and the seed."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols], F.lit(str(seed))).cast("binary"))


def records(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str | None = None, kind: str = "text") -> DataFrame:
    """Documents of any kind as sampling records (doc_id, text, source, metadata); blank ones go."""
    named = F.col(source) if source else F.col(id_col).cast("string")
    meta = F.create_map(F.lit("type"), F.lit(kind), F.lit("length"), F.length(text).cast("string"))
    return docs.filter(F.length(F.trim(F.col(text))) > 0).select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.coalesce(named, F.lit("unknown")).alias("source"), meta.alias("metadata"))


def skip_fold(rows: DataFrame, budget: int, order: list[str], size: Column, stop: bool = False) -> DataFrame:
    """Rows in order as long as they fit, going on past those that don't; `stop` ends once the budget is used up.

    The rows are those of one sample: a few hundred, on which everything after depends in order.
    """
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.struct(*rows.columns).alias("_row"), size.cast("long").alias("_size"))))
    begun = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["_size"] <= budget
        if stop:
            fits = fits & (acc["used"] < budget)
        return F.struct(F.when(fits, acc["used"] + x["_size"]).otherwise(acc["used"]).alias("used"), F.array_append(acc["taken"], fits).alias("taken"))

    one = rows.agg(items.alias("items"))
    one = one.select("items", F.aggregate("items", begun, step, lambda a: a["taken"]).alias("taken"))
    return one.select(F.explode(F.arrays_zip("items", "taken")).alias("z")).filter("z.taken").select("z.items._row.*")


def pattern_samples(docs: DataFrame, budget: int) -> DataFrame:
    """doc_id, sample: `[Patterns - source] ...` of documents in order that have any, until the budget is used up."""
    p = docs.select("doc_id", "source", rich_patterns_any(F.col("text")).alias("p")).filter("p <> ''")
    p = p.select("doc_id", F.concat(F.lit("[Patterns - "), "source", F.lit("] "), "p").alias("sample"))
    # each costs 17 characters and more: those past the first budget / 17 + 1 that fit can't be taken any more
    first = p.filter(F.length("sample") <= budget).orderBy("doc_id").limit(budget // 17 + 1)
    return skip_fold(first, budget, ["doc_id"], F.length("sample"), stop=True)


def middle_sentences(docs: DataFrame, each: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, source, sentence, k: of texts of 200 characters, random sentences of over 30 from the middle half."""
    quarter = F.floor(F.length("text") / 4)
    middle = F.substring(F.col("text"), quarter + 1, 2 * quarter)
    bare = F.transform(F.split(middle, "[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    s = docs.filter(F.length("text") >= 200).select("doc_id", "source", F.posexplode(F.filter(bare, lambda x: F.length(x) > 30)).alias("at", "sentence"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(seeded(seed, "doc_id", "at"), "at"))
    return s.withColumn("k", k).filter(F.col("k") <= each).select("doc_id", "source", "sentence", "k")


def random_samples(docs: DataFrame, budget: int, each: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, k, sample: mid-document sentences of documents in order, under the budget."""
    s = middle_sentences(docs, each, seed)
    first = s.filter(F.length("sentence") <= budget).orderBy("doc_id", "k").limit(budget // 31 + 1)
    kept = skip_fold(first, budget, ["doc_id", "k"], F.length("sentence"))
    return kept.select("doc_id", "k", F.concat(F.lit("[Random - "), "source", F.lit("] "), "sentence").alias("sample"))


def combined(samples: DataFrame, budget: int) -> DataFrame:
    """part, k, sample in order: near-equal samples once (the first), packed with their separators under the budget."""
    first = F.row_number().over(Window.partitionBy("_key").orderBy("part", "k"))
    once = samples.withColumn("_key", sample_key(F.col("sample"))).withColumn("_first", first).filter("_first = 1").drop("_key", "_first")
    return skip_fold(once.select("part", "k", "sample"), budget, ["part", "k"], F.length("sample") + 2).orderBy("part", "k")


def corpus_sample(docs: DataFrame, budget: int = 12_000, seed: int = 42) -> DataFrame:
    """part, k, sample of documents (doc_id, text, source): all strategies together, nine strata of documents first."""
    from quillgraph.operators.storage import saved
    from quillgraph.plans.catalog_engine import diverse_segments
    from quillgraph.plans.catalog_text import features, stratified

    chosen = saved(docs.join(F.broadcast(stratified(features(docs))), "doc_id").select("doc_id", "text", "source"))  # 50 documents at most
    a, b, c = (int(budget * s) for s in SHARES)
    units = chosen.select("doc_id", "source", F.explode(F.slice(text_units(F.col("text")), 1, 10)).alias("segment"))
    best = diverse_segments(chosen.select("doc_id", "text"), seed=seed, units=units).join(chosen.select("doc_id", "source"), "doc_id")
    best = skip_fold(best.select("cluster", "doc_id", "source", "segment"), a, ["cluster"], F.length("segment"))
    diverse = best.select(F.lit(0).alias("part"), F.col("cluster").cast("long").alias("k"), F.concat(F.lit("["), "source", F.lit("] "), "segment").alias("sample"))
    patterns = pattern_samples(chosen, b).select(F.lit(1).alias("part"), F.col("doc_id").cast("long").alias("k"), "sample")
    middle = random_samples(chosen, c, seed=seed).select(F.lit(2).alias("part"), (F.col("doc_id") * 10 + F.col("k")).cast("long").alias("k"), "sample")
    return combined(diverse.unionByName(patterns).unionByName(middle), budget)


def older_sample(docs: DataFrame, files: int = 20, edge: int = 15_000, budget: int = 350_000, long: int = 1000) -> DataFrame:
    """doc_id, sample: title, beginning, end and patterns of the first documents, until the budget is passed.

    A smaller `edge` and budget (500 and 8,000) give the oldest variant.
    """
    d = docs.filter(F.length(F.trim("text")) > 0).orderBy("doc_id").limit(files)
    first, last = F.trim(F.left("text", F.lit(edge))), F.when(F.length("text") > long, F.trim(F.right("text", F.lit(edge))))
    patterns = rich_patterns_any(F.col("text"))
    parts = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Document: "), F.coalesce("source", F.lit("unknown"))),
        F.when(F.length(first) > 0, F.concat(F.lit("Beginning: "), first)),
        F.when((F.length(last) > 0) & (last != first), F.concat(F.lit("End: "), last)),
        F.when(patterns != "", F.concat(F.lit("Patterns: "), patterns)),
    )
    s = d.select("doc_id", parts.alias("sample"))
    w = Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)  # of `files` rows
    before = F.coalesce(F.sum(F.length("sample") + 2).over(w), F.lit(0))
    room = s.withColumn("before", before).filter(F.col("before") < budget)
    return room.select("doc_id", F.left("sample", (F.lit(budget) - F.col("before")).cast("int")).alias("sample"))
