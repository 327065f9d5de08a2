"""Periodic runs against plain Python: every run by every period, the digests, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(words, least):
    """(start, stop, period): of equal stretches the smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                out.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e, q) for (s, e), q in out.items())


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_are_those_of_every_period(least):
    rng = random.Random(least)
    for _ in range(600):
        ids = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(4)):
            if ids:
                a = rng.randrange(len(ids))
                ids[a:a] = ids[a : a + rng.randrange(1, 14)] * rng.randrange(1, 7)
        want = _plain(ids, least)
        assert runs.runs(np.array(ids, dtype=np.int64), least) == want
        assert not ids or runs.runs_of(ids, least) == want


def test_famous_words():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert runs.runs_of(b, 2) == _plain(b, 2)
    morse = [bin(i).count("1") % 2 for i in range(512)]
    assert runs.runs_of(morse, 2) == _plain(morse, 2)


def test_factors_are_longest_earlier_strings():
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(3) for _ in range(rng.randrange(1, 50))]
        at = 0
        for start, stop, earlier in runs.factors(ids):
            longest = max((next((k for k in range(len(ids) - start) if ids[j + k] != ids[start + k]), len(ids) - start) for j in range(start)), default=0)
            assert start == at and stop - start == max(1, longest)
            if earlier >= 0:
                assert earlier < start and ids[earlier : earlier + stop - start] == ids[start:stop]
            at = stop
        assert at == len(ids)


def _row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = _plain(words, 12)
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2])) if found else None
    told = (best[0], best[1] - best[0], best[2], (best[1] - best[0]) * 1000 // best[2]) if best else (None,) * 4
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in found)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *told, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), sha(" ".join(kept)))


def test_rows(spark):
    rng = random.Random(9)
    line = "one line of seven words stands here\n"
    texts = [(i, " ".join(rng.choice(["ab", "é", "c d", "e"]) for _ in range(rng.randrange(300)))) for i in range(60)]
    texts += [(1000 + i, line * rng.randrange(1, 9) + "tail " * rng.randrange(20)) for i in range(40)]
    texts += [(5, "twice"), (5, "twice"), (None, "no id " * 9), (2**60 + 1, "big id " * 30), (7, None), (8, ""), (9, " \n\x0b\t ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("bytes", "start", "length", "period", "n_runs")})
    got = sorted(map(tuple, runs.periodic_runs(docs).collect()), key=repr)
    assert got == sorted((_row(i, t) for i, t in texts), key=repr)


def test_long_texts_and_empty_tables(spark):
    copies = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, f"{copies} {copies} {copies}"), (3, " ".join(f"u{i}" for i in range(100_000))), (4, "same " * 100_000)]
    assert all(zlib.crc32(str(i).encode()) % 10 for i, _ in rows)
    got = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_runs, got[i].start, got[i].length, got[i].period) for i in (1, 3, 4)] == [(1, 0, 90_000, 30_000), (0, None, None, None), (1, 0, 100_000, 1)]
    assert got[1].collapsed_sha256 == hashlib.sha256(copies.encode()).hexdigest()
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
