"""The inverted index against BM25 by hand: results, blocks that are read, appending, what is told of it."""

import contextlib
import io
import math
import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from quillgraph.operators import text_index as TI
from quillgraph.operators.storage import table_path


def _texts(n, seed=2):
    rng = random.Random(seed)
    common = [f"{a}{b}" for a in "abcdefg" for b in "uvw"]
    out = {}
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.02:
            words += ["Rare"] * rng.randrange(1, 4)
        if i == n // 2:
            words = ["rare"] * 30
        out[i] = " ".join(words) + rng.choice(["", ".", " 12 né"])
    return out | {n: None, n + 1: ""}


def _bm25(texts, terms):
    words = {i: [w for w in re.split("[^a-z]+", t.lower()) if w] for i, t in texts.items() if t is not None}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for t in set(terms):
        df = sum(t in w for w in words.values())
        idf = math.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
        for i, w in words.items():
            if t in w:
                tf = w.count(t)
                out[i] = out.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return out


def _frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


@pytest.fixture(scope="module")
def small_segments():
    patch = pytest.MonkeyPatch()
    patch.setattr(TI, "SEGMENT", 16)
    patch.setattr(TI, "FIRST_SEGMENTS", 2)
    yield
    patch.undo()


@pytest.fixture(scope="module")
def texts():
    return _texts(1500)


@pytest.fixture(scope="module")
def path(spark, texts, small_segments):
    where = table_path(spark)
    TI.build(_frame(spark, texts), where)
    return where


@pytest.mark.parametrize("terms, k", [(["rare"], 5), (["rare", "au"], 10), (["au", "bv", "gw", "nothing"], 3), (["au"], 2000), (["rare", "rare"], 1), (["nothing"], 5), ([], 5)])
def test_top_k_is_that_of_all_documents(spark, texts, path, terms, k):
    got = [(r.id, r.score) for r in TI.top_k(spark, path, terms, k).collect()]
    want = sorted(_bm25(texts, terms).items(), key=lambda x: (-x[1], x[0]))[:k] if terms else []
    assert len(got) == len(want)
    assert [s for _, s in got] == pytest.approx([s for _, s in want])
    assert all(_bm25(texts, terms)[i] == pytest.approx(s) for i, s in got)


def test_blocks_that_cannot_matter_are_not_read(spark, path):
    _, few = TI.scored(spark, path, ["rare"], 1)
    assert 0 < few["read"] <= 4 < few["blocks"]
    _, every = TI.scored(spark, path, ["rare"], 10_000)
    assert every["read"] == every["blocks"] == few["blocks"]


def test_only_the_terms_buckets_are_opened(spark, path):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        TI.postings(spark, path, ["rare"]).select("segment", "n", "most", "least").explain("formatted")
    plan = out.getvalue()
    assert "PartitionFilters: [isnotnull(bucket" in plan and re.search(r"PushedFilters: \[.*term.*rare", plan) and "ids" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_documents_are_added_without_a_rebuild(spark, texts, small_segments):
    where = table_path(spark)
    some = {i: t for i, t in texts.items() if i < 700}
    assert TI.status(spark, where, _frame(spark, some)) == ["missing"]
    TI.build(_frame(spark, some), where)
    files = set(spark.read.parquet(f"{where}/blocks").inputFiles())
    assert TI.status(spark, where, _frame(spark, texts)) == [f"{len(texts) - 700} documents lacking"]
    TI.added(_frame(spark, texts), where)
    TI.added(_frame(spark, texts), where)
    assert files < set(spark.read.parquet(f"{where}/blocks").inputFiles()) and TI.status(spark, where, _frame(spark, texts)) == []
    assert TI.opened(spark, where).docs == len(texts)
    got = {r.id: r.score for r in TI.top_k(spark, where, ["rare", "au"], 3000).collect()}
    assert got == pytest.approx(_bm25(texts, ["rare", "au"]))


def test_empty_tables(spark):
    where = table_path(spark)
    TI.build(_frame(spark, {1: None, 2: ""}), where)
    assert TI.top_k(spark, where, ["a"], 3).count() == 0 and TI.opened(spark, where).docs == 2


@pytest.mark.parametrize("docs, most", [(7, 10**6), (1000, 300)])
def test_segments_hold_every_posting(docs, most):
    texts = {f"d{i}": t for i, t in _texts(100).items()}
    rows = pa.table({"id": list(texts), "text": [t and t.lower() for t in texts.values()]})
    found = pa.Table.from_batches(TI._segments(iter(rows.to_batches(max_chunksize=30)), 5 << 24, docs, most)).to_pylist()
    words = {i: re.findall("[a-z]+", (t or "").lower()) for i, t in texts.items()}
    got = [(r["term"], i, tf, n) for r in found for i, tf, n in zip(r["ids"], r["tfs"], r["lens"], strict=True)]
    assert sorted(got) == sorted((t, i, w.count(t), len(w)) for i, w in words.items() for t in set(w))
    assert all((r["n"], r["most"], r["least"], r["words"]) == (len(r["ids"]), max(r["tfs"]), min(r["lens"]), sum(r["tfs"])) and r["n"] <= docs for r in found)
    segments = sorted({r["segment"] for r in found})
    assert segments == list(range(5 << 24, (5 << 24) + len(segments))) and len(segments) > 5


def test_a_posting_takes_few_bytes():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    rows = pa.table({"id": range(1000), "text": [" ".join(rng.choices(words, k=300)) for _ in range(1000)]})
    tracemalloc.start()
    n = sum(b.num_rows for b in TI._segments(iter(rows.to_batches()), 0, 2000, 10**6))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len({w for t in rows["text"].to_pylist() for w in t.split()})
    assert peak < 300_000 * 60  # beside what Arrow holds
