"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training is a stream over a bounded sample of labelled documents in one task; every coordinate has its own
learning rate, and the L1 term leaves only the weights that pay. What is left, a few thousand (index, weight)
pairs out of at most 2**bits, is what scoring tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches
from quillgraph.llm.words import U64, WordHashes, joined, mixed

BITS = 20
#: Documents that are learnt from, at most: those whose hashed doc_id comes first.
MAX_TRAIN = 12_000


def _normal(word: bytes) -> bytes:
    return word.lower().strip(b".,;:!?\"'()[]|#*$%&<>-") or word


def features(text: str | None, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Distinct indices of a text's words, pairs, triples and pairs one word apart; index 2**bits is the bias."""
    h = hashes.of((text or "").encode().split())
    parts = [mixed(h)]
    if len(h) > 1:
        parts.append(joined(h[:-1], h[1:]))
    if len(h) > 2:
        parts += [joined(h[:-2], h[1:-1], h[2:]), joined(~h[:-2], h[2:])]
    index = np.concatenate(parts) >> U64(64 - bits)
    return np.append(np.unique(index.astype(np.int64)), 1 << bits)


class Ftrl:
    """FTRL-proximal with L1 and L2 over binary features."""

    def __init__(self, bits: int = BITS, alpha: float = 0.4, beta: float = 1.0, l1: float = 2.5, l2: float = 0.1):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        lazy = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, lazy)

    def learn(self, index: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[index]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] = n + g * g


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """order, doc_id, text, toxic of at most `most` labelled documents outside the held-out fifth, one label a document."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).filter(~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(most)
    # at most `most` rows of three numbers: small enough to send everywhere, so that no text is shuffled for it
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order", "doc_id", "text", "toxic")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(rows: DataFrame, bits: int = BITS, epochs: int = 2) -> list[tuple[int, float]]:
    """The non-zero weights; none if there are no rows. The rows are learnt in hash order, so reruns agree."""

    def fit(batches):
        hashes = WordHashes(_normal)
        rows = []
        for pdf in batches:  # texts go as soon as their features are known
            rows += [(o, d, xxhash.xxh3_64_intdigest((t or "").encode()), features(t, hashes, bits).astype(np.int32), int(y)) for o, d, t, y in zip(pdf["order"], pdf["doc_id"], pdf["text"], pdf["toxic"])]
        if rows:
            model = Ftrl(bits)
            rows.sort(key=lambda r: r[:3])
            for _ in range(epochs):
                for *_, index, label in rows:
                    model.learn(index, label)
            w = model.weights(slice(None))
            kept = np.flatnonzero(w)
            yield pd.DataFrame({"index": kept, "weight": w[kept]})

    found = small_batches(rows).repartition(1).mapInPandas(fit, "index long, weight double").toPandas()
    return list(zip(found["index"].tolist(), found["weight"].tolist()))


def scorer(weights: list[tuple[int, float]], bits: int = BITS):
    """A function of the text column: its score. Without any weight every score is 0."""
    index, weight = np.array([i for i, _ in weights], dtype=np.int32), np.array([w for _, w in weights], dtype=np.float32)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense, hashes = np.zeros((1 << bits) + 1), WordHashes(_normal)
        dense[index] = weight
        for texts in batches:
            total = np.array([dense[features(t, hashes, bits)].sum() for t in texts], dtype=float)
            yield pd.Series(1 / (1 + np.exp(-total)) if len(index) else np.zeros(len(texts)))

    return F.pandas_udf(run, "double")


def without_toxic(docs: DataFrame, labels: DataFrame, bits: int = BITS, most: int = MAX_TRAIN, least: float = 0.5) -> DataFrame:
    """docs without the rows that score `least` or more; all columns stay, whatever their names.

    Only texts go to Python and only scores come back. Without usable labels nothing is known and all rows stay;
    null and empty texts score by the bias alone; repeated rows go or stay together; an empty table gives none.
    """
    weights = train(training_rows(docs, labels, most), bits)
    return small_batches(docs).filter(scorer(weights, bits)("text") < least) if weights else docs


def score_documents(docs: DataFrame, labels: DataFrame, bits: int = BITS, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Labels of other values than 0 and 1, or without doc_id, are not learnt from; a document labelled more than
    once counts as toxic if one label says so. Rows without doc_id are scored and not held out. An empty table
    gives no rows; other columns are ignored.
    """
    score = scorer(train(training_rows(docs, labels, most), bits), bits)
    scored = small_batches(docs).select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
