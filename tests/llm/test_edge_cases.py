"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import licenses, line_dedup, line_quality, mixing, near_dup, neighbours, packing, secrets, suffix_dedup, toxicity

WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "under the MIT License and token = 'abcdef123'\nsecond line of this text here", "a"),
    (2, "under the MIT License and token = 'abcdef123'\nsecond line of this text here", "a"),
    (3, None, "b"),
    (4, "", None),
    (5, LONG, "b"),
    (5, LONG, "b"),
    (None, "no id here, under the MIT License", "a"),
    (6, " \n\t ", "c"),
    (7, "x", "c"),
]
SCHEMA = "doc_id long, text string, source string"
OPERATORS = {
    "quality": lambda d, labels: line_quality.judge_documents(d, labels),
    "suffix": lambda d, _: suffix_dedup.removed_spans(d),
    "packing": lambda d, _: packing.pack_documents(d),
    "mixing": lambda d, _: mixing.mix_sources(d),
    "toxicity": lambda d, labels: toxicity.score_documents(d, labels),
    "licenses": lambda d, _: licenses.scan_licenses(d),
    "near": lambda d, _: near_dup.near_duplicates(d),
    "lines": lambda d, _: line_dedup.line_report(d),
    "secrets": lambda d, _: secrets.find_secrets(d),
}


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    # columns whose names operators use inside
    clash = ("rid", "block", "bucket", "size", "h", "n", "words", "score", "spans", "keys", "label", "id", "key", "digest", "order", "group", "kind", "start", "packed")
    return d.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (1, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_give_a_row_each(spark, docs, labels, name):
    rows = OPERATORS[name](docs, labels).collect()
    if name == "packing":
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        assert sum(1 for r in rows if r.doc_id in (3, 4)) == 2
    else:
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, labels, name):
    out = OPERATORS[name](spark.createDataFrame([], SCHEMA), labels)
    assert out.collect() == [] and "doc_id" in out.columns


def test_quality_base_and_verdict(spark, docs, labels):
    got = {r.doc_id: r for r in line_quality.judge_documents(docs, labels.limit(0)).collect()}
    assert got[3].n_words == got[4].n_words == got[6].n_words == 0 and got[4].base_failed and not got[4].kept
    assert got[5].n_words == 30_000 and got[5].n_repeat_words == 30_000 and got[5].base_failed
    assert got[1].word_chars == sum(map(len, re.findall(WORD, ROWS[0][1])))


def test_viterbi_beats_every_labelling():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(1)
    for n in range(1, 8):
        odds, stay = rng.normal(size=n).tolist(), rng.normal(size=2).tolist()
        value = lambda ls: sum(o for o, x in zip(odds, ls) if x) + sum(stay[a] for a, b in zip(ls, ls[1:]) if a == b)  # noqa: B023, E731
        assert abs(value(line_quality.viterbi(odds, stay)) - max(map(value, product((0, 1), repeat=n)))) < 1e-9


def test_suffix_rows_with_one_id_keep_their_bytes(spark, docs):
    got = {r.doc_id: r for r in suffix_dedup.removed_spans(docs).collect()}
    assert got[5].n_removed > 0 or got[5].n_bytes > 0
    assert got[1].n_removed == 0 and got[2].n_removed == len(ROWS[1][1].encode()) and got[2].n_spans == 1
    assert got[2].kept_sha256 == got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_near_classes(spark, docs):
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    assert got[2].component_id == 1 and not got[2].kept and got[1].kept
    assert got[3].n_shingles == 0 and got[3].kept and got[4].component_id == 4 and got[7].n_shingles == 1
    assert got[None].kept and got[None].component_id is None


def test_licenses_and_secrets(spark, docs):
    lic = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (lic[1].n_base, lic[1].first_word, lic[1].base_labels, lic[1].labels) == (1, 0, "mit", "mit")
    assert lic[3].n_words == 0 and lic[3].first_word is None and lic[3].score == 0
    sec = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    at = ROWS[0][1].index("token")
    assert sec[1].spans == f"assign:{at}:{at + len('token = ') + 1 + 9}" and sec[1].n_assign == 1
    assert sec[3].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_secret_ledger_scans_only_the_unseen(spark, tmp_path):
    path = str(tmp_path / "ledger")
    files = lambda: {str(p) for p in tmp_path.glob("ledger/part-*.parquet")}
    schema = "doc_id long, text string"
    old = spark.createDataFrame([(1, "AKIA" + "A" * 16), (2, "plain"), (3, "plain")], schema)
    assert {r.doc_id: r.n_access for r in secrets.find_secrets(old, path).collect()} == {1: 1, 2: 0, 3: 0}
    assert secrets.read_ledger(spark, path).count() == 2
    assert secrets.update_ledger(old, secrets.read_ledger(spark, path)).count() == 0
    # a ledger's word counts: a known blob isn't scanned again
    spark.read.parquet(path).withColumn("spans", F.slice("spans", 1, 0)).write.parquet(path + "2")
    assert {r.doc_id: r.n_access for r in secrets.find_secrets(old, path + "2").collect()} == {1: 0, 2: 0, 3: 0}
    before = files()
    both = old.union(spark.createDataFrame([(4, "AKIA" + "B" * 16)], schema))
    assert {r.doc_id: r.n_access for r in secrets.find_secrets(both, path).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}
    assert secrets.read_ledger(spark, path).count() == 3 and before <= files()


def test_lines(spark, docs):
    got = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert got[1].n_removed == 0 and got[2].removed == "0,1" and got[3].n_lines == 0 and got[4].n_lines == 1
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert kept[2] == "" and kept[3] is None and kept[1] == ROWS[0][1]
    assert got[2].stays == "1:0,1:1" and got[1].stays == ""


def test_short_lines_go_only_if_equal(spark):
    rows = [(1, "abc\nabd\n\n}\nabc"), (2, "abc \n}\n\nabe"), (2, "}\nnew"), (3, None)]
    out = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_lines, r.removed, r.stays) for r in out) == collections.Counter([(1, 5, "4", "1:0"), (2, 4, "1", "1:3"), (2, 2, "0", "1:3"), (3, 0, "", "")])


def test_stages_keep_columns_of_any_name(spark):
    names = ("removed", "copies", "copy", "t", "line_no", "h", "n", "share", "size", "taken", "_shorter", "score", "of", "x.y")
    rows = [(1, "a plain line of many words here\nmore", "a"), (2, "a plain line of many words here\nmore of it", "a"), (2, "a plain line of many words here\nmore of it", "a"), (None, "lone", None), (3, None, "b"), (4, "", "b")]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in names})
    lines = line_dedup.dedup_lines(d, drop_blank=True)
    assert lines.columns == d.columns and {r.text for r in lines.collect()} == {rows[0][1], "more of it", "lone", None, ""}
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns and mixed.collect() and all(r["copy"] == r["copies"] == r["x.y"] == "clash" for r in mixed.collect())
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.without_toxic(d, labels).columns == d.columns
    assert mixing.mixed_documents(d.limit(0)).collect() == line_dedup.dedup_lines(d.limit(0)).collect() == []


def test_neighbours(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (2, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [0.5, 0.5])]
    got = [tuple(r)[:4] for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 1.0), (0, 2, 2, 0.5), (0, 3, 3, 0.5), (20, 1, 0, 1.0), (20, 2, 2, 0.5), (20, 3, 3, 0.5)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    clash = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("dim", "shard", "block", "score", "rank", "scored", "query_id", "label")})
    assert [tuple(r)[:4] for r in neighbours.nearest(clash).orderBy("query_id", "rank").collect()] == got
