"""Label discovery: a model reads one sample of a corpus and proposes entity labels; approved ones are cached."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.jsonrepair import repaired
from quillgraph.operators.sampling import corpus_sample, older_sample
from quillgraph.sources.readers import read_state, write_state

#: Labels when a model gives none, and when none of its labels is approved. Fixed values.
FALLBACK = ["PERSON", "ORGANIZATION", "LOCATION", "CONCEPT", "DOCUMENT"]
BASIC = ["PERSON", "ORGANIZATION", "LOCATION", "CONCEPT"]
_CACHE = "signature string, labels array<string>, at bigint"


def offline_labels(prompt: str) -> str:
    """The offline model: runs of capitals in the sample, most frequent first."""
    import collections
    import re

    words = collections.Counter(re.findall(r"\b[A-Z]{3,}\b", prompt))
    return json.dumps([w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))])


def labels_of(said: str, most: int) -> list[str]:
    """The labels in a model's answer: strings of two or more characters in capitals; the fallback if it has no JSON."""
    found = repaired(said)
    listed = json.loads(found) if found else None
    if not isinstance(listed, list):
        return list(FALLBACK)
    return [x for x in listed if isinstance(x, str) and len(x) > 1 and x.isupper()][:most]


def discover(sample: str, model: Callable[[str], str] = offline_labels, most: int = 20, domain: str | None = None) -> list[str]:
    """Labels for one sample text; a hint names the domain. A failing model gives the fallback."""
    prompt = (f"Domain: {domain}\n\n" if domain else "") + sample
    try:
        return labels_of(model(prompt), most)
    except Exception:
        return list(FALLBACK)


def discover_corpus(docs: DataFrame, model: Callable[[str], str] = offline_labels, most: int = 20, domain: str | None = None, enhanced: bool = True, budget: int = 12_000) -> list[str]:
    """Labels for documents (doc_id, text, source), from the enhanced sample or the older one."""
    s = corpus_sample(docs, budget) if enhanced else older_sample(docs, budget=budget).orderBy("doc_id")
    # a sample is `budget` characters at most
    return discover("\n\n".join(r["sample"] for r in s.collect()), model, most, domain)


def approved(proposed: list[str], choice: str = "a") -> list[str]:
    """`a`: all; `n`: the basic labels; else comma-separated numbers from 1. Unknown numbers don't count."""
    if choice == "a" or not proposed:
        return list(proposed)
    if choice == "n":
        return list(BASIC)
    try:
        chosen = [proposed[i - 1] for i in map(int, choice.split(",")) if 1 <= i <= len(proposed)]
    except ValueError:
        chosen = []
    if not chosen:
        raise ValueError(f"no label is chosen by {choice!r}")
    return chosen


def corpus_key(docs: DataFrame) -> str:
    """12 digits for a corpus, whatever the order of its documents: counts and sums of hashes over all of them."""
    h = F.xxhash64(F.col("doc_id").cast("string"), F.length("text"))
    low, high = F.sum(F.pmod(h, F.lit(1 << 31))), F.sum(F.shiftrightunsigned(h, 33))
    row = docs.agg(F.left(F.md5(F.concat_ws(":", F.count(F.lit(1)), low, high).cast("binary")), F.lit(12)).alias("k")).first()
    return row["k"]


def cached_labels(spark: SparkSession, docs: DataFrame, path: str, find: Callable[[DataFrame], list[str]] = discover_corpus, approve: Callable[[list[str]], list[str]] = approved) -> list[str]:
    """Approved labels of a corpus: from the cache at `path` if its key is there, else found, approved and kept."""
    key = corpus_key(docs)
    known = read_state(spark, path, _CACHE).filter(F.col("signature") == key).first()
    if known:
        return list(known["labels"])
    labels = approve(find(docs))
    n = read_state(spark, path, _CACHE).count()
    write_state(spark, path, spark.createDataFrame([(key, labels, n)], _CACHE), "signature", "at")
    return labels
