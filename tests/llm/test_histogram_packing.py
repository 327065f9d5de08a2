"""Packing by least squares: round trips, full sequences, the solution against a plain descent, odd rows."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import histogram_packing as H

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _holds(rows, texts, tokenizer, window):
    """Every id lies in one piece, sequences have no holes and need no padding."""
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for d, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at & (at - 1) == 0
    return sequences


def test_pieces_of_the_small_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = H.pack_by_histogram(docs)
    rows = packed.collect()
    assert packed.columns == COLUMNS
    sequences = _holds(rows, {r.doc_id: r.text for r in docs.collect()}, tokenizer, H.WINDOW)
    total = sum(r.length for r in rows)
    assert len(sequences) < total / H.WINDOW + 8 * 12


@pytest.mark.parametrize("window", [16, 64])
def test_one_length_may_hold_most_rows(spark, tokenizer, window, monkeypatch):
    monkeypatch.setattr(H, "CHUNK_PIECES", 100)
    rng = random.Random(window)
    texts = {i: " ".join(["word"] * (11 if rng.random() < 0.6 else rng.randrange(150))) for i in range(400)}
    rows = H.pack_by_histogram(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), window).collect()
    _holds(rows, texts, tokenizer, window)


def test_odd_rows(spark, tokenizer):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, long), (4, "é" * 50), (5, "twice"), (5, "twice"), (None, "no id"), (2**60 + 1, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("start", "length", "ids", "sequence_id", "offset")})
    got = H.pack_by_histogram(docs).collect()
    assert collections.Counter(r.doc_id for r in got if r.start == 0) == collections.Counter(i for i, _ in rows)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert sum(r.length for r in got) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert H.pack_by_histogram(docs.limit(0)).count() == 0


def test_combinations_are_all_that_fill_the_window():
    counts = np.zeros(25)
    counts[[3, 4, 5, 8, 9, 12, 15, 16, 20, 21]] = 1
    have = np.flatnonzero(counts).tolist()
    want = {(a, b, c) for a in have for b in have for c in [0, *have] if a >= b >= c and a + b + c == 24}
    assert set(map(tuple, H.combinations(counts, 24).tolist())) == want


def test_solution_is_that_of_a_plain_descent():
    rng = np.random.default_rng(4)
    for spike in (0, 3000):
        window = 20
        counts = np.zeros(window + 1)
        counts[1:window] = rng.integers(0, 900, window - 1)
        counts[13] += spike
        combos = H.combinations(counts, window)
        matrix = np.zeros((window + 1, len(combos)))
        for place in range(3):
            np.add.at(matrix, (combos[:, place], np.arange(len(combos))), 1)
        matrix[0] = 0
        weight = np.arange(window + 1) / window
        missed = lambda x: float(weight @ (counts - matrix @ x) ** 2)  # noqa: B023, E731
        x = np.zeros(len(combos))
        for _ in range(60_000):
            x = np.maximum(x + matrix.T @ (weight * (counts - matrix @ x)) / 60, 0)
        mine = H.least_squares(counts, combos, window)
        assert mine.min() >= 0 and missed(mine) <= 1.02 * missed(x) + 5


def test_exact_histograms_are_packed_without_a_cut():
    counts = np.zeros(H.WINDOW + 1)
    for lengths, n in (((1000, 900, 148), 40), ((1500, 548), 25), ((1024, 512, 512), 30)):
        for length in lengths:
            counts[length] += n
    combos, often = H.planned(counts)
    rows = [(i, 0, bytes(4 * length), length) for i, length in enumerate(np.repeat(np.arange(H.WINDOW + 1), counts.astype(int)).tolist())]
    chunk = H.Chunk(rows, H.WINDOW)
    chunk.combine(combos, often)
    chunk.fill()
    assert chunk.sequences == 95 and len(chunk.out) == len(rows)
