"""Queries over whole tables against plain Python; the catalogue's SQL covers them too where they have one."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.plans import catalog, catalog_text


def rows(spark, sf_dir, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).collect()]


@pytest.fixture(scope="module")
def edges(spark, sf_dir):
    held = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
        held[r.l_orderkey].add(r.l_suppkey)
    return {p for s in held.values() for p in itertools.permutations(s, 2)}


def test_paths_take_every_node(spark, sf_dir, edges):
    two = [(m, far) for s, m in edges if s == 1 for x, far in edges if x == m and far != 1]
    assert sorted(rows(spark, sf_dir, "two_hop_paths")) == sorted(two)
    hops = {far: 2 for _, far in two} | {m: 1 for s, m in edges if s == 1} | {1: 0}
    assert dict(rows(spark, sf_dir, "quantified_path_0_2")) == hops


@pytest.mark.parametrize("n", [0, 3, 5, 13, 1000])
def test_folds_are_ntile(spark, n):
    ids = [7 * i for i in range(n)]
    size, more = divmod(n, 5)
    want, at = [], 0
    for fold in range(1, 6):
        k = size + (fold <= more)
        if k:
            want.append((fold, k, ids[at]))
        at += k
    d = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert sorted(map(tuple, catalog_text.folds(d, 5, 50).collect())) == want


def test_results_cover_the_tables(spark, sf_dir):
    count = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    assert sum(n for _, n, _ in rows(spark, sf_dir, "report_folds")) == count("documents")
    assert rows(spark, sf_dir, "entity_coverage")[0][:2] == (count("supplier"),) * 2


def patterns(text):
    found = re.findall(r"\b[A-Z]{2,}(?:\s+[A-Z]{2,})*\b", text)[:10] + re.findall(r'"([^"]{2,50})"', text)[:5]
    return " | ".join(found + re.findall(r"(?:^|\n)\s*[•\-*]\s*([^\n]{5,100})", text, re.MULTILINE)[:8])


def test_patterns_of_every_document(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if r.text is not None}
    want = {i: patterns(x) for i, x in docs.items() if re.search('[A-Z]{2,}|"', x)}
    assert any(not docs[i].isascii() for i in want)
    assert dict(rows(spark, sf_dir, "pattern_extract")) == want


@pytest.mark.parametrize("text", ["ÜBER BERÜ NASA\u00a0HQ é AB", 'die "größte Straße" ja', "x\u2028- no bullet here\n\u00a0• ein Punkt für alle", "ab² CD² EF_ GH\u0301 IJ"])
def test_patterns_outside_ascii(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(C.rich_patterns_any(F.col("t"))).first()[0] == patterns(text)


def test_answers_read_whole_texts(spark, sf_dir):
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text").collect()}
    pairs = {k: (x, turns[k[0], k[1] + 1]) for k, x in turns.items() if (k[0], k[1] + 1) in turns}
    bare = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    words = lambda x: [w for w in re.split(r"[\t-\r ]+", x.lower().translate(bare)) if w not in ("", "a", "an", "the")]
    assert any(len(x) > 200 for x, _ in pairs.values())
    assert {(c, n): x for c, n, x in rows(spark, sf_dir, "normalise_answer")} == {k: " ".join(words(x)) for k, (x, _) in pairs.items()}
    assert rows(spark, sf_dir, "exact_match") == [(len(pairs), sum(words(x) == words(y) for x, y in pairs.values()))]


def test_first_of_equal_writers_is_the_first_line(spark, tmp_path):
    import duckdb

    lines = [(k % 7, 5, 1, f"2020-01-{k % 28 + 1:02d}", "NRA"[k % 3]) for k in range(60)]
    df = spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_shipdate string, l_returnflag string")
    df.coalesce(1).toPandas().to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    assert sorted(rows(spark, str(tmp_path), "upsert_first_writer")) == sorted(con.sql(catalog.ORACLE_SQL["upsert_first_writer"]).fetchall())


def test_first_writer_with_null_numbers(spark, tmp_path):
    import duckdb

    null = lambda k, n, x: None if k % n == 0 else x
    lines = [(null(k, 50, k % 7), null(k, 3, 90 - k), null(k, 4, k % 5), null(k, 9, f"2020-01-{k % 28 + 1:02d}"), null(k, 11, "NRA"[k % 3])) for k in range(90)]
    df = spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_shipdate string, l_returnflag string")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(rows(spark, str(tmp_path), "upsert_first_writer"), key=str) == sorted(con.sql(catalog.ORACLE_SQL["upsert_first_writer"]).fetchall(), key=str)


def test_concise_answers_of_odd_texts(spark, tmp_path):
    import duckdb

    texts = ["Yes, fine", "No, le soir", "based on the context, x", "The answer is answer: x", "answer: the answer is x", "answer: answer: y", "\u00a0 x\u3000", "\tx\n", "yes\u00a0", "YES ", None, ""]
    texts += ["\u0391\u03a3", "\u0130X", "The an\u017fwer i\u017f 5", "the answer \u0131s 5", "\u03a3\u0391\u03a3. " + "x" * 60, " . " * 30, "No" + "x" * 70, "yes no. " * 9, "\U0001f600" * 60, "x" * 49 + " .", "The answer is  true "]
    spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string").withColumn("turn", F.lit(0)).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = {i: x for i, _, x in con.sql(catalog.ORACLE_SQL["concise_answer"]).fetchall()}
    assert {i: x for i, _, x in rows(spark, str(tmp_path), "concise_answer")} == want


def test_legacy_labels_go_over_whole_strings(spark):
    from quillgraph.plans.catalog_more import legacy_label

    texts = ["small PLATED copper-7z Brand#12", "9th a_b", "", "x1Yz__Q-q", "é9é", None]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", legacy_label(F.col("x")).alias("label"))
    assert [r.label for r in found.orderBy("i").collect()] == ["Small_Plated_Copper_7Z_Brand12", "Entity_9Th_A_B", "", "X1Yz__Q_Q", "Entity_9", None]
    # no expression for each character
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
