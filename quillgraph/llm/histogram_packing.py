"""Packing by non-negative least squares over the histogram of lengths.

Documents longer than a window give whole windows and a rest. Which combinations of up to three lengths that fill a
window exactly are used, and how often, is the non-negative solution of a least squares problem against the
histogram of all rests and shorter documents. The solution is found once for the corpus, from a table of one row
per length. Every task then rounds it to its share of the pieces, and packs what is left over greedily: the longest
piece that fits, or, if none fits, a cut of the shortest one. So windows are full; what remains of a chunk of
pieces at last is laid out in sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, written
from quillgraph.llm.packing import Encoder

WINDOW = 2048
END_OF_TEXT = 1
#: What a task packs at once: pieces, or bytes of their ids.
CHUNK_PIECES, CHUNK_BYTES = 32_768, 32 << 20

_SIZED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sized_pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """A row per whole window of every document, with its checksum, and one for the rest, with its ids."""

    def run(batches):
        encode = Encoder(path, END_OF_TEXT)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encode(text)
                n = len(ids) // 4
                whole = n - n % window
                rows += [(key, s, window, zlib.crc32(ids[4 * s : 4 * (s + window)]), n, None) for s in range(0, whole, window)]
                if whole < n:
                    rows.append((key, whole, n - whole, None, n, ids[4 * whole :]))
            out = {c: pd.array(v, dtype="Int64") for c, v in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), zip(*rows))}
            yield pd.DataFrame(out | {"ids": [r[5] for r in rows]})

    # as strings, for ids beyond what a float holds next to nulls
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    return small_batches(texts).mapInPandas(lambda b: run(_with_ids(b)), _SIZED)


def _with_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(doc_id=pd.array([None if i is None else int(i) for i in pdf["doc_id"]], dtype="Int64"))


def combinations(counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All (a, b, c) of lengths that occur, a >= b >= c, which add up to the window; c is 0 for pairs."""
    a, c = np.meshgrid(np.arange(1, window), np.arange(0, window // 3 + 1), indexing="ij")
    b = window - a - c
    there = np.concatenate(([True], counts[1:window] > 0))  # no third piece is always there
    ok = (b <= a) & (b >= c) & (b > 0)
    a, b, c = a[ok], b[ok], c[ok]
    some = there[a] & there[b] & there[c]
    return np.stack((a[some], b[some], c[some]), axis=1)


def least_squares(counts: np.ndarray, combos: np.ndarray, window: int = WINDOW, exact: float = 1e-6) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that bring the lengths they use closest to counts, by tokens.

    Descent by coordinates, steepest first: a pass takes those combinations whose own best step is at least half of
    the largest, each by its best step at that time, so few combinations are used. It ends when no step is larger
    than a quarter of a piece, or than a share of `exact` of all pieces, or when passes over such steps gain less
    than a thousandth.
    """
    weight = np.arange(window + 1) / window
    rest, heavy = counts.astype(float).copy(), weight.tolist()
    rest[0] = 0.0
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    a, b, c = combos.T
    # a length that a combination holds m times counts m * m
    norm = weight[a] + weight[b] + weight[c] + 2 * (weight[a] * (a == b) + weight[b] * (b == c) + weight[a] * (a == c))
    least, level, before = max(0.25, exact * counts.sum()), np.inf, np.inf
    while True:
        step = np.abs(np.maximum((weight[a] * rest[a] + weight[b] * rest[b] + weight[c] * rest[c]) / norm, -x))
        largest = float(step.max())
        missed = float(weight @ (rest * rest))
        slow, before = missed > 0.999 * before, missed
        if largest < least or (slow and level <= least):
            return x
        level = max(least, min(largest / 2, level / 2 if slow else level))
        steep = np.flatnonzero(step >= level)
        left = rest.tolist()
        for k in steep[np.argsort(-step[steep], kind="stable")].tolist():
            lengths = combos[k].tolist()
            move = max(sum(heavy[n] * left[n] for n in lengths) / norm[k], -x[k])
            if abs(move) >= level:
                x[k] += move
                for n in lengths:
                    left[n] -= move
                left[0] = 0.0
        rest = np.array(left)


def planned(counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The combinations in use and their repeat counts, most frequent first."""
    combos = combinations(counts, window)
    x = least_squares(counts, combos, window)
    order = np.argsort(-x, kind="stable")
    order = order[x[order] > 0]
    return combos[order], x[order]


class Chunk:
    """Pieces that are packed together: rows (doc_id, start, ids, doc_tokens) by length, and sequences as they close."""

    def __init__(self, rows: list[tuple], window: int):
        self.window, self.by_length = window, [[] for _ in range(window)]
        for row in rows:
            self.by_length[len(row[2]) // 4].append(row)
        self.pieces, self.out, self.sequences = len(rows), [], 0

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for key, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.out.append((key, start, n, zlib.crc32(ids), tokens, self.sequences, at))
            at += n
        self.sequences += 1

    def combine(self, combos: np.ndarray, share: np.ndarray) -> None:
        """Each combination as often as its rounded share says, then as often as pieces last."""
        for often in (np.rint(share).astype(np.int64).tolist(), [self.pieces] * len(share)):
            for lengths, n in zip(combos.tolist(), often):
                stacks = [self.by_length[l] for l in lengths if l]  # noqa: E741
                while n > 0 and all(len(s) >= sum(o is s for o in stacks) for s in stacks):
                    self.close([s.pop() for s in stacks])
                    n -= 1

    def fill(self) -> None:
        """All that is left, in full sequences: the longest piece that fits, else a cut of the shortest."""
        there = [l for l in range(1, self.window) if self.by_length[l]]  # noqa: E741
        now, gap = [], self.window
        while there:
            i = bisect_right(there, gap)
            length = there[i - 1] if i else there[0]
            stack = self.by_length[length]
            key, start, ids, tokens = stack.pop()
            if not stack:
                there.remove(length)
            if length > gap:
                rest = (key, start + gap, ids[4 * gap :], tokens)
                if not self.by_length[length - gap]:
                    insort(there, length - gap)
                self.by_length[length - gap].append(rest)
                ids, length = ids[: 4 * gap], gap
            now.append((key, start, ids, tokens))
            gap -= length
            if not gap:
                self.close(now)
                now, gap = [], self.window
        self.halve(now, self.window - gap)

    def halve(self, pieces: list[tuple], total: int) -> None:
        """Pieces of `total` ids in sequences of powers of two, largest first."""
        queue = pieces[::-1]
        for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
            now, gap = [], size
            while gap:
                key, start, ids, tokens = queue.pop()
                if len(ids) // 4 > gap:
                    queue.append((key, start + gap, ids[4 * gap :], tokens))
                    ids = ids[: 4 * gap]
                now.append((key, start, ids, tokens))
                gap -= len(ids) // 4
            self.close(now)


def packed_chunks(sized: DataFrame, combos: np.ndarray, often: np.ndarray, total: int, window: int = WINDOW) -> DataFrame:
    """Every task's pieces in sequences, chunk by chunk, without a shuffle. Sequences are numbered by partition."""

    def pack(rows: list[tuple]) -> tuple[list[tuple], int]:
        chunk = Chunk(rows, window)
        chunk.combine(combos, often * (len(rows) / max(total, 1)))
        chunk.fill()
        return chunk.out, chunk.sequences

    def frame(rows: list[tuple], base: int) -> pd.DataFrame:
        names = [f.split()[0] for f in _PACKED.split(", ")]
        out = pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in zip(names, zip(*rows))}, columns=names)
        return out.assign(sequence_id=out["sequence_id"] + base)

    def run(batches):
        base, held, size = TaskContext.get().partitionId() << 40, [], 0
        for pdf in batches:
            # whole windows are sequences of their own
            whole = [(k, s, n, crc, t, i, 0) for i, (k, s, n, crc, t) in enumerate(zip(*(pdf.loc[pdf["ids"].isna(), c].tolist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens"))))]
            if whole:
                yield frame(whole, base)
                base += len(whole)
            rest = pdf[pdf["ids"].notna()]
            held += zip(rest["doc_id"].tolist(), rest["start"].tolist(), rest["ids"].tolist(), rest["doc_tokens"].tolist())
            size += int(rest["length"].sum()) * 4
            if len(held) >= CHUNK_PIECES or size >= CHUNK_BYTES:
                rows, n = pack(held)
                yield frame(rows, base)
                base, held, size = base + n, [], 0
        if held:
            yield frame(pack(held)[0], base)

    texts = sized.withColumn("doc_id", F.col("doc_id").cast("string"))
    return small_batches(texts).mapInPandas(lambda b: run(_with_ids(b)), _PACKED)


def pack_by_histogram(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Null and empty texts are the end id alone; rows repeated with one doc_id, or without, are packed each; an
    empty table gives no rows; other columns are ignored. What the driver holds is a count for each length.
    """
    sized = written(sized_pieces(docs, window, path))
    counts = np.zeros(window + 1)
    for length, n in sized.filter("ids is not null").groupBy("length").count().collect():  # one row a length below the window
        counts[length] = n
    combos, often = planned(counts, window)
    return packed_chunks(sized, combos, often, int(counts.sum()), window)
