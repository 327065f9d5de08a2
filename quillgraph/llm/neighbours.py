"""Nearest vectors by inner product with a hash-prefix forest.

Every tree of the forest rotates all vectors at random and gives each a long hash string: its symbols are the
signed axes along which the rotated vector reaches farthest, the farthest first. A tree is the sorted array of
these strings. A query looks up its own string in every tree, and those that differ from it by a change in the
order of its farthest axes; it descends to the longest prefixes that anything shares and then ascends in all trees
at once, prefix by prefix and string by string, until it has candidates enough. Candidates are scored in double
precision on the vectors themselves.

How many candidates are enough grows with the square root of the number of vectors, so that work grows by its
power 1.5. Index vectors are dealt into shards of bounded expected size and queries into blocks; one task holds the
forest of one shard and answers one block of queries, and a shard gives its share of the candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches

#: Trees of a forest, symbols of a string, and candidates (counted once a tree and step) for the square root of all vectors.
TREES, SYMBOLS, ENOUGH = 128, 4, 24.0
#: How a query ascends: (symbols that must agree, by places among the query's farthest axes), all trees at a time.
_PAIRS = sorted(((a, b) for a in range(7) for b in range(7) if a != b), key=lambda p: (p[0] + p[1] + (p[0] > p[1]) / 2, p))
ASCENT = [(0, 1, 2, 3), (0, 1, 2), *_PAIRS, *((a,) for a in range(7))]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), dim of vectors that aren't null, empty, zero or without finite components.

    Rows repeated with one vec_id and vector are one.
    """
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = vectors.select("vec_id", e.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False)))
    return small_batches(some).dropDuplicates(["vec_id", "embedding"]).withColumn("dim", F.size("embedding"))


def _reach(x: np.ndarray, rotation: np.ndarray, most: int) -> np.ndarray:
    """The `most` farthest signed axes of every rotated vector, farthest first, as symbols from 0."""
    y = x @ rotation
    far, at = np.abs(y), np.arange(len(x))
    out = np.empty((len(x), most), dtype=np.int64)
    for i in range(most):
        axis = far.argmax(axis=1)
        out[:, i] = 2 * axis + (y[at, axis] > 0)
        far[at, axis] = -1.0
    return out


class Forest:
    """Sorted arrays of the hash strings of x, one array a tree."""

    def __init__(self, x: np.ndarray, trees: int = TREES, symbols: int = SYMBOLS, seed: int = 7):
        squares = (x * x).sum(axis=1)
        self.norm = math.sqrt(squares.max())
        # one component more gives all vectors the same norm: angles then order as inner products do
        rest = np.sqrt(np.maximum(squares.max() - squares, 0.0))
        self.level = rest.max() <= 1e-6 * self.norm
        x = (x if self.level else np.column_stack([x, rest])) / self.norm
        x = x.astype(np.float32)
        dim, self.n, self.trees = x.shape[1], len(x), trees
        self.bits = max(1, int(2 * dim - 1).bit_length())
        self.symbols = max(1, min(symbols, dim, 63 // self.bits))
        self.probes = min(max(max(s) for s in ASCENT) + 1, dim)
        rng = np.random.default_rng(seed)
        self.rotations = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32) for _ in range(trees)]
        self.order = np.empty((trees, len(x)), dtype=np.int32)
        self.strings = np.empty((trees, len(x)), dtype=np.uint64)
        for t, rotation in enumerate(self.rotations):
            code = self._joined(_reach(x, rotation, self.symbols))
            self.order[t] = np.argsort(code, kind="stable")
            self.strings[t] = code[self.order[t]]

    def _joined(self, reach: np.ndarray) -> np.ndarray:
        code = np.zeros(len(reach), dtype=np.uint64)
        for i in range(reach.shape[1]):
            code = code << np.uint64(self.bits) | reach[:, i].astype(np.uint64)
        return code

    def ranges(self, reach: np.ndarray, step: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """First place (in all trees laid end to end) and number of strings that begin with the queries' symbols."""
        drop = np.uint64(self.bits * (self.symbols - len(step)))
        low, high = np.empty(reach.shape[:2], dtype=np.int64), np.empty(reach.shape[:2], dtype=np.int64)
        for t in range(self.trees):
            prefix = self._joined(reach[t][:, list(step)])
            low[t] = np.searchsorted(self.strings[t], prefix << drop, side="left")
            high[t] = np.searchsorted(self.strings[t], prefix + np.uint64(1) << drop, side="left")
        return (low + np.arange(self.trees)[:, None] * self.n).T, (high - low).T

    def candidates(self, q: np.ndarray, want: int, k: int, ids: np.ndarray) -> list[np.ndarray]:
        """For every query, by number: the places in x of its candidates.

        Ranges of the sorted strings are looked up step by step of the ascent, for those queries only that have not
        yet `want` candidates (counted once a tree and step) and more than k different ids; who still lacks them at
        the root gets all.
        """
        unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        unit = (unit if self.level else np.column_stack([unit, np.zeros(len(q))])).astype(np.float32)
        reach = np.stack([_reach(unit, rotation, self.probes) for rotation in self.rotations])
        marked, counted, open_ = [np.empty(0, dtype=np.int32)] * len(q), np.zeros(len(q), dtype=np.int64), np.arange(len(q))
        flat = self.order.reshape(-1)
        for step in dict.fromkeys(s[: self.symbols] for s in ASCENT if max(s[: self.symbols]) < self.probes):
            base, size = self.ranges(reach[:, open_], step)
            total = size.sum(axis=1)
            for j in np.flatnonzero(total):
                n = size[j]
                at = np.repeat(base[j] - (np.cumsum(n) - n), n) + np.arange(total[j])
                marked[open_[j]] = np.concatenate([marked[open_[j]], flat[at]])
            counted[open_] += total
            enough = np.zeros(len(open_), dtype=bool)
            for i in np.flatnonzero(counted[open_] >= want):
                marked[open_[i]] = np.unique(marked[open_[i]])
                # one of them may be the query itself
                enough[i] = len(np.unique(ids[marked[open_[i]]])) > k
            open_ = open_[~enough]
            if not len(open_):
                break
        for j in open_:
            marked[j] = np.arange(self.n, dtype=np.int32)
        return marked


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int = 20, want: int | None = None, at_once: int = 512, **forest) -> pd.DataFrame:
    """query_id, vec_id, score, scored: the k best candidates of each query within one shard, ties to smaller vec_id.

    An id with several vectors is one candidate, with its best score; scored, in a query's first row: how many
    vectors were looked at.
    """
    want = math.ceil(ENOUGH * math.sqrt(len(x))) if want is None else want
    alone = len(np.unique(ids)) == len(ids)
    trees = Forest(x, **forest) if want < len(x) else None
    rows = []
    for begin in range(0, len(q), at_once):
        part = q[begin : begin + at_once]
        for i, found in enumerate(trees.candidates(part, want, k, ids) if trees else [np.arange(len(x))] * len(part), begin):
            found = found[ids[found] != query_ids[i]]
            if not len(found):
                continue
            scored, near = len(found), x[found] @ q[i]
            if len(found) > k and alone:
                found = found[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9 * max(1.0, np.abs(near).max())]
            exact = (x[found] * q[i]).sum(axis=1)
            best = np.lexsort((ids[found], -exact))
            if not alone:
                best = best[np.sort(np.unique(ids[found[best]], return_index=True)[1])]
            best = best[:k]
            rows.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": ids[found[best]], "score": exact[best], "scored": np.where(np.arange(len(best)) == 0, scored, 0)}))
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "scored": []}).astype({"query_id": "int64", "vec_id": "int64", "scored": "int64"})
    return pd.concat(rows) if rows else none


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard: int = 16_384, block: int = 16_384, enough: float = ENOUGH) -> DataFrame:
    """query_id, rank, vec_id, score, scored: for each vec_id divisible by `every`, its k nearest others.

    scored: how many vectors the forests of all shards made candidates for the query. Unusable vectors (see `usable`) neither ask
    nor answer; vectors of different lengths never meet; rows repeated with one vec_id and vector count once; a
    vec_id with several vectors counts by the best; a query alone has no rows; an empty table gives none; other
    columns are ignored.
    """
    some = usable(vectors)
    total = some.count()
    shards, blocks = max(1, -(-total // shard)), max(1, -(-total // (every * block)))
    share = enough / math.sqrt(max(1, total))
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    index = some.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", cells(blocks))
    asked = some.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).withColumn("shard", cells(shards))
    schema = "query_id long, vec_id long, score double, scored long"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "scored": []}).astype({"query_id": "int64", "vec_id": "int64", "scored": "int64"})
        x, q = np.stack(left["embedding"].to_numpy()), np.stack(right["embedding"].to_numpy())
        return search(left["vec_id"].to_numpy(), x, right["vec_id"].to_numpy(), q, k, math.ceil(share * len(x)))

    key = ("dim", "shard", "block")
    found = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, schema)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("scored").alias("scored"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    looked = F.sum("scored").over(Window.partitionBy("query_id"))
    return once.withColumn("scored", looked).withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored")
