"""A stored inverted index: postings by term in blocks, with what bounds a block's scores, and a top-k by BM25 that
reads only blocks which can still matter.

Documents are numbered in segments of up to SEGMENT neighbours. A block holds one term's documents of one segment
with frequencies and lengths, and apart from them their number, the highest frequency and the shortest length. As
these two bound a block's BM25 whatever the collection's averages are, documents can be added without touching what
is there. A search reads the heads of its terms' blocks, scores the most promising segments, and then all others
whose bound reaches the k-th score. The blocks lie in folders by a hash of the term, sorted by term and segment.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.storage import saved

#: Documents of a segment, words that end one early, folders of terms, segments that a search scores first.
SEGMENT, SEGMENT_WORDS, BUCKETS, FIRST_SEGMENTS = 1024, 2_000_000, 64, 8
_WORDS = re.compile("[a-z]+")
#: BM25's parameters, and what scores may differ by and still count as equal.
K1, B, SLACK = 1.2, 0.75, 2e-6


@dataclass(frozen=True)
class Head:
    """Documents, those with a text, all their words, and how often documents were added."""

    docs: int
    texts: int
    words: int
    generation: int

    @property
    def mean(self) -> float:
        return self.words / self.texts if self.texts else 0.0


def _bucket(term) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, f"{path}/head/_SUCCESS")
    return fs.exists(where)


def opened(spark: SparkSession, path: str) -> Head:
    if not exists(spark, path):
        raise FileNotFoundError(f"no text index at {path}")
    return Head(**spark.read.parquet(f"{path}/head").first().asDict())


def _segments(batches: Iterator[pa.RecordBatch], first: int, docs: int, most: int) -> Iterator[pa.RecordBatch]:
    """The blocks of documents (id, text), segment by segment: of `docs` documents, or fewer once they have over `most` words.

    A posting is three numbers in arrays: as Python's objects they would take some hundred bytes.
    """

    def segment() -> pa.RecordBatch:
        term, order = np.frombuffer(of, "i4"), np.argsort(np.frombuffer(of, "i4"), kind="stable")
        n = np.bincount(term, minlength=len(terms))
        ends = np.concatenate([[0], np.cumsum(n)])
        doc, tf = np.frombuffer(at, "i4")[order], np.frombuffer(tfs, "i4")[order]
        length, begin = np.frombuffer(lens, "i4")[doc], ends[:-1]
        lists = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        each = {
            "term": pa.array(list(terms), pa.string()), "segment": np.full(len(n), first + number), "n": n.astype("i4"), "most": np.maximum.reduceat(tf, begin), "least": np.minimum.reduceat(length, begin),
            "words": np.add.reduceat(tf.astype("i8"), begin), "ids": lists(pa.array(ids, kind).take(pa.array(doc))), "tfs": lists(pa.array(tf)), "lens": lists(pa.array(length)),
        }
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in each.values()], names=list(each))

    number, size, kind = 0, 0, None
    terms, ids, lens, of, at, tfs = {}, [], array("i"), array("i"), array("i"), array("i")
    for few in (b.slice(s, 64) for b in batches for s in range(0, b.num_rows, 64)):
        kind = few.column("id").type
        for key, text in zip(few.column("id").to_pylist(), few.column("text").to_pylist()):
            counts = Counter(m.group() for m in _WORDS.finditer(text or ""))
            if counts:
                of.extend(terms.setdefault(t, len(terms)) for t in counts)
                at.extend([len(ids)] * len(counts))
                tfs.extend(counts.values())
                ids.append(key)
                lens.append(counts.total())
                size += lens[-1]
            if len(ids) == docs or size > most:
                yield segment()
                number, size = number + 1, 0
                terms, ids, lens, of, at, tfs = {}, [], array("i"), array("i"), array("i"), array("i")
    if ids:
        yield segment()


def _blocks(docs: DataFrame, generation: int) -> DataFrame:
    """The blocks of documents (id, text): a segment is a run of neighbours in a task, so its blocks are made there."""
    kind, bounds = dict(docs.dtypes)["id"], (SEGMENT, SEGMENT_WORDS)
    run = lambda batches: _segments(batches, (generation << 48) + (TaskContext.get().partitionId() << 24), *bounds)
    lowered = docs.filter("text is not null").select("id", F.lower("text").alias("text"))
    return lowered.mapInArrow(run, f"term string, segment long, n int, most int, least int, words long, ids array<{kind}>, tfs array<int>, lens array<int>")


def _append(docs: DataFrame, path: str, head: Head) -> Head:
    """Documents (id, text) that the index doesn't hold, in segments of their own."""
    spark, where = docs.sparkSession, f"{path}/blocks/generation={head.generation}"
    n, texts = docs.agg(F.count(F.lit(1)), F.count("text")).first()
    # a bucket with a hot term may be several files; each is sorted by term
    laid = _blocks(docs, head.generation).withColumn("bucket", _bucket("term")).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "segment")
    laid.write.mode("overwrite").partitionBy("bucket").parquet(where)
    docs.select("id").write.mode("overwrite").parquet(f"{path}/ids/generation={head.generation}")
    new = spark.read.schema("words long").parquet(where).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    now = Head(head.docs + n, head.texts + texts, head.words + new, head.generation + 1)
    row = spark.createDataFrame([(now.docs, now.texts, now.words, now.generation)], "docs long, texts long, words long, generation int")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
    return now


def _ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/ids").select("id")


def build(docs: DataFrame, path: str, id_col: str = "doc_id") -> Head:
    """The index of docs (id_col, text) at `path`, whatever was there before. Words are lower-case and cut at anything
    but letters a to z. Null texts count as documents without words. The head is written last: an index without is missing."""
    fs, where = _fs(docs.sparkSession, path)
    fs.delete(where, True)
    return _append(docs.select(F.col(id_col).alias("id"), "text"), path, Head(0, 0, 0, 0))


def added(docs: DataFrame, path: str, id_col: str = "doc_id") -> Head:
    """The index with documents whose ids it doesn't hold; nothing that is there is written again."""
    spark = docs.sparkSession
    head = opened(spark, path)
    new = docs.select(F.col(id_col).alias("id"), "text").join(_ids(spark, path), "id", "left_anti")
    return head if new.isEmpty() else _append(new, path, head)


def postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The blocks of some terms; other buckets' files are not opened, other terms' row groups are skipped."""
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket("term")).distinct().collect()]
    return spark.read.parquet(f"{path}/blocks").filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def _gain(tf: Column, length: Column, idf: Column, mean: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _idf(terms: list[str], df: dict[str, int], docs: int) -> Column:
    """Each term's weight, a constant per term."""
    import math

    return F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(math.log(1 + (docs - df[t] + 0.5) / (df[t] + 0.5))))])[F.col("term")]


def _scores(blocks: DataFrame, idf: Column, mean: float) -> DataFrame:
    each = blocks.select("term", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("d"))
    return each.select(F.col("d.ids").alias("id"), _gain(F.col("d.tfs"), F.col("d.lens"), idf, mean).alias("g")).groupBy("id").agg(F.sum("g").alias("score"))


def scored(spark: SparkSession, path: str, terms: list[str], k: int) -> tuple[DataFrame, dict[str, int]]:
    """(id, score of the documents that may be among the k best, all of those that are), and how many blocks the
    terms have and how many of them were read."""
    head, terms = opened(spark, path), sorted(set(terms))
    empty = _ids(spark, path).select("id", F.lit(0.0).alias("score")).limit(0)
    if not terms or not head.words:
        return empty, {"blocks": 0, "read": 0}
    blocks = postings(spark, path, terms)
    heads = saved(blocks.select("term", "segment", "n", "most", "least"))
    df = {r["term"]: r["n"] for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term asked for
    if not df:
        return empty, {"blocks": 0, "read": 0}
    idf = _idf(sorted(df), df, head.docs)
    bound = _gain(F.col("most"), F.col("least"), idf, head.mean)
    segments = saved(heads.withColumn("bound", bound).groupBy("segment").agg(F.sum("bound").alias("bound"), F.count(F.lit(1)).alias("blocks"), F.max("n").alias("n")))
    best, held, parts = [], 0, []
    # the most promising segments, as many as hold k documents at least
    for r in segments.orderBy(F.desc("bound"), "segment").limit(max(FIRST_SEGMENTS, k)).collect():
        if len(best) >= FIRST_SEGMENTS and held >= k:
            break
        best.append(r["segment"])
        held += r["n"]
    first = saved(_scores(blocks.filter(F.col("segment").isin(best)), idf, head.mean))
    parts.append(first)
    kth = first.orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count(F.lit(1))).first()
    bar = kth[0] - SLACK if kth[1] == k else float("-inf")
    others = segments.filter(~F.col("segment").isin(best) & (F.col("bound") >= bar))
    total, read = segments.agg(F.sum("blocks")).first()[0], segments.filter(F.col("segment").isin(best) | (F.col("bound") >= bar)).agg(F.sum("blocks")).first()[0]
    rest = [r["segment"] for r in others.select("segment").limit(SEGMENT + 1).collect()]
    if 0 < len(rest) <= SEGMENT:  # few: their numbers prune row groups
        parts.append(_scores(blocks.filter(F.col("segment").isin(rest)), idf, head.mean))
    elif rest:
        parts.append(_scores(blocks.join(others.select("segment"), "segment", "left_semi"), idf, head.mean))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out, {"blocks": int(total), "read": int(read)}


def top_k(spark: SparkSession, path: str, terms: list[str], k: int) -> DataFrame:
    """id, score: the k documents with the highest BM25, ties to smaller ids."""
    return scored(spark, path, terms, k)[0].orderBy(F.desc("score"), "id").limit(k)


def status(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id") -> list[str]:
    """Why an index at `path` doesn't serve `docs`: missing, or documents it lacks or holds beyond them."""
    if not exists(spark, path):
        return ["missing"]
    held, ids = _ids(spark, path), docs.select(F.col(id_col).alias("id"))
    lacks, beyond = ids.join(held, "id", "left_anti").count(), held.join(ids, "id", "left_anti").count()
    return [f"{n} documents {what}" for n, what in ((lacks, "lacking"), (beyond, "too many")) if n]
