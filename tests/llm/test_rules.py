"""Plain Python against the line counts, the learner, the SQL of queries and the pipeline's stages on odd rows."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import line_dedup, line_quality, near_dup, queries, toxicity
from quillgraph.llm.common import spread_join, written
from quillgraph.llm.words import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "a b a b a b", "\u00a0 one\u2028two \u00e9", "x\ny\nx\n\n \n \nX\nx ", "#*$%&|<> ##", "w " * 60, "one two three four one two three", "same line\x0bhere\nsame line\x0bhere"]


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, twice, len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def test_line_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(ODD)], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.union(odd).collect()}
    got = {r.doc_id: r for r in line_quality.judge_documents(docs.union(odd), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    for i, text in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(text), text
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)


def test_verdicts_on_documents_it_has_not_learnt(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in line_quality.judge_documents(docs, labels.filter("doc_id % 2 = 0")).collect()}
    rest = [(r.quality, got[r.doc_id].kept) for r in labels.filter("doc_id % 2 = 1").collect() if not got[r.doc_id].base_failed]
    assert len(rest) > 15 and sum(kept == bool(q) for q, kept in rest) >= 0.9 * len(rest)


def test_learner_against_plain_loop():
    hashes = WordHashes(toxicity._normal)
    texts = [("good words are here", 0), ("bad slur is here", 1), ("good words and a slur", 1), ("are here", 0), ("", 0)] * 8
    alpha, beta, l1, l2 = 0.4, 1.0, 0.5, 0.1
    model = toxicity.Ftrl(12, alpha, beta, l1, l2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for text, label in texts:
        index = toxicity.features(text, hashes, 12)
        w = {i: weight(i) for i in index.tolist()}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in w:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
        model.learn(index, label)
    got = model.weights(slice(None))
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in z) and sum(map(bool, got)) == sum(bool(weight(i)) for i in z) > 0


def test_features_are_grams_and_skips():
    hashes = WordHashes(toxicity._normal)
    words = "a b c a b d".split()
    grams = {(w,) for w in words} | set(zip(words, words[1:])) | set(zip(words, words[1:], words[2:])) | {("skip", *p) for p in zip(words, words[2:])}
    assert len(toxicity.features(" ".join(words), hashes, 40)) == len(grams) + 1
    assert toxicity.features(None, hashes).tolist() == [1 << toxicity.BITS]
    assert (toxicity.features("Slur, here", hashes) == toxicity.features("slur HERE!", hashes)).all()


@pytest.mark.parametrize("name", ["op2_prefix_free_dedup", "op8_minhash_near_dup"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_spread_join_is_a_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(1000)] + [(-1, None)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k3", 3), ("none", 4)], "k string, v int")
    counts = left.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left"):
        want = left.join(right, "k", how).select("i", "k", "v").collect()
        got = spread_join(left, right, ["k"], counts, 1001, ["i"], how).select("i", "k", "v").collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    long = " ".join(f"word{i % 997}" for i in range(20_000))
    near = " ".join(f"n{i}" for i in range(60))
    rows = [(1, "a plain text that stays " + near), (2, "an other plain text " + near), (3, None), (4, ""), (5, long), (5, long), (None, "no id but words"), (None, None), (6, "slur"), (7, "\n\n"), (8, "first line of it here\nmore")]
    docs = spark.createDataFrame([(i, x, "en", "s" if i else None, len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("removed", "copies", "copy", "score", "kept", "size", "taken", "x.y")})
    spark.createDataFrame([(1, 1, 0), (6, 0, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        now, ids = written(table), []
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, str(tmp_path)))
            if name != "packing":
                assert now.columns == docs.columns and now.filter("removed <> 'clash' or `x.y` <> 'clash'").count() == 0
            ids.append(collections.Counter(r.doc_id for r in now.select("doc_id").collect()))
        if table is docs:
            assert {1, 5, 8} <= set(ids[1]) and 2 not in ids[2] and 1 in ids[2] and {1, 5, 8} <= set(ids[3]) | {8} and not {3, 4, 7} & set(ids[3])
            assert sum(ids[4].values()) >= len(ids[3])
        else:
            assert not any(ids)


def test_near_duplicate_stage_is_five_words_at_four_fifths(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = {r.doc_id: [w.lower() if w.isascii() else w for w in WORD.findall(r.text or "")] for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in words.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j]) if i < j else 0
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group_stays(spark, docs, sf_dir).select("doc_id").collect()}
    assert kept == {i for i in sets if root(i) == i} and len(kept) < len(sets)
    assert near_dup.near_duplicates(docs, 5, 80, 10).count() == docs.count()


def test_line_stage_drops_what_the_report_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    gone = {r.doc_id: {int(x) for x in r.removed.split(",") if x} for r in line_dedup.line_report(docs).collect()}
    want = {i: x if not gone[i] else "\n".join(line for k, line in enumerate(x.split("\n")) if k not in gone[i]) for i, x in texts.items()}
    want = {i: x for i, x in want.items() if not gone[i] or x.strip()}
    assert {r.doc_id: r.text for r in corpus_pipeline.repeated_lines_go(spark, docs, sf_dir).collect()} == want
