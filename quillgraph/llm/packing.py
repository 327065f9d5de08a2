"""Sum-of-squares packing of token pieces into sequences.

A bin with gap g has g places left. A piece goes where the sum over all gaps of the squared number of open
bins with that gap becomes smallest, which keeps bins of every residual gap at hand and waste sublinear.
Pieces are dealt into groups of bounded expected size by a hash; each group is packed on its own, longest
pieces first. The bins that a group leaves with more than a few free places are opened again and their
pieces packed once more, in groups that gather the rest of many first groups.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, written

CAPACITY = 1024
END_OF_TEXT = 2


#: Pre-tokens of the byte-level vocabulary. Fixed value.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: printable Latin-1 ones as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Texts to the bytes of their ids (32-bit little-endian), the end id included.

    The merges of the tokenizer file at `path` are run by tiktoken, which gives the same ids several times as
    fast: in this vocabulary a token's id is its merge's rank.
    """

    def __init__(self, path: str | None = None, end: int = END_OF_TEXT):
        import tiktoken

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        letter = _byte_of_letter()
        ranks = {bytes(letter[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("byte level", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)
        self.end = end.to_bytes(4, "little")

    def __call__(self, text: str | None) -> bytes:
        return np.array(self.encoding.encode(text or "", allowed_special="all"), dtype="<u4").tobytes() + self.end


def cut(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """piece, start, length, crc32 of a document's ids; only the first of several pieces is shorter."""
    n = len(ids) // 4
    start, piece = 0, 0
    while start < n:
        stop = n if n <= capacity else start + (n % capacity or capacity) if start == 0 else start + capacity
        yield piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])
        start, piece = stop, piece + 1


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """key, rid (the row's number), piece, start, length, ids_crc32: one row per piece of every row's text."""

    def run(batches):
        encode = Encoder(path)
        for pdf in batches:
            rows = [(k, r, *p) for k, r, t in zip(pdf[key], pdf["rid"], pdf["text"]) for p in cut(encode(t), capacity)]
            yield pd.DataFrame(rows, columns=[key, "rid", "piece", "start", "length", "ids_crc32"])

    numbered = docs.select(key, "text", F.monotonically_increasing_id().alias("rid"))
    return small_batches(numbered).mapInPandas(run, f"{key} long, rid long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, placed in the order given. Ties go to the tightest bin, then to a new one."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; full ones aren't counted
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            # how the sum changes, by the gap after: a bin leaves the gap before and joins the one after, if any
            cost = 2 * (count[: capacity - size] - count[size:capacity]) + 2
            cost[0] -= 1
            cost[count[size:capacity] == 0] = 1 << 60
            best = int(cost.argmin())
            if cost[best] <= 2 * int(count[capacity - size]) + 1:
                gap = best + size
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap - size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return bins, offsets


def pack(sized: DataFrame, groups: int, regroups: int = 1, capacity: int = CAPACITY, slack: int = 8) -> DataFrame:
    """sized (rid, piece, length and any others) with sequence_id and offset.

    A group is packed in one task and holds about its share of the pieces; `groups` grows with the input.
    """
    own = sized.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema.fields)

    def once(pdf: pd.DataFrame, base: int) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "rid", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=bins + base, offset=offsets)

    def first(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = once(pdf, key[0] << 32)
        fill = out.groupby("sequence_id")["length"].transform("sum")
        return out.assign(again=fill < capacity - slack).drop(columns="group")

    def second(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return once(pdf.drop(columns=["group", "sequence_id", "offset", "again"]), (groups + key[0]) << 32)

    dealt = sized.withColumn("group", F.pmod(F.xxhash64("rid", "piece"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInPandas(first, f"{schema}, sequence_id long, offset long, again boolean")
    rest = packed.filter("again").withColumn("group", F.pmod(F.xxhash64("piece", "rid", F.lit(2)), F.lit(regroups)))
    closed = packed.filter("not again").select(*own, "sequence_id", "offset")
    return closed.unionByName(rest.groupBy("group").applyInPandas(second, f"{schema}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, group_docs: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null and empty texts are the end id alone; rows repeated with one doc_id, or without, are packed each; an
    empty table gives no rows; other columns are ignored.
    """
    n = docs.count()
    groups = max(1, -(-n // group_docs))
    sized = written(pieces(docs, capacity, path))
    return pack(sized, groups, max(1, groups // 8), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
