"""Table functions from SQL, against the column forms of the same operators."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import tables
from quillgraph.operators.chunking import chunks
from quillgraph.plans import build, textquery

rows = lambda df: sorted(map(str, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    tables.registered(spark)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = d.withColumn("text", F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.concat("text", F.lit(' Section 1 A\nNorth Atlantic Treaty met "some quoted words".\n\nNorth Atlantic Treaty'))))
    d.createOrReplaceTempView("udtf_documents")
    return d


def test_chunk_text(spark, docs):
    got = spark.sql("select chunk_id, cast(doc_id as string), index, section, text from chunk_text(TABLE(udtf_documents), size => 300, overlap => 50)")
    assert rows(got) == rows(chunks(docs, size=300, overlap=50))
    got = spark.sql("select chunk_id, cast(doc_id as string), index, section, text from chunk_text(TABLE(select doc_id, text, 1 as size from udtf_documents), size => 300, overlap => 50, sections => true)")
    assert rows(got) == rows(chunks(docs, size=300, overlap=50, sections=True))
    assert spark.sql("select * from chunk_text(TABLE(select cast(null as bigint) as doc_id, 'x y' as text))").collect()[0][:2] == (None, None)
    assert spark.sql("select * from chunk_text(TABLE(select * from udtf_documents where false))").count() == 0
    for call, said in [("TABLE(select 1 as doc_id)", "no column text"), ("1", "is a table"), ("TABLE(udtf_documents), size => 10, overlap => 10", "smaller"), ("TABLE(udtf_documents), size => 0", "constant")]:
        with pytest.raises(Exception, match=said):
            spark.sql(f"select * from chunk_text({call})").collect()


def test_named_spans(spark, docs):
    c = chunks(docs, size=300, overlap=50)
    c.createOrReplaceTempView("udtf_chunks")
    got = spark.sql("select * from named_spans(TABLE(udtf_chunks))")
    m = build.mentions(c)
    want = m.groupBy("doc_id", "name", "kind").agg(F.min("chunk_id").alias("first_chunk"), F.count_distinct("chunk_id").alias("n_chunks"))
    assert rows(got) == rows(want) and got.filter("kind = 'PHRASE'").count() > 0
    # chunking and extraction in one statement, grouped by what they give
    n = spark.sql("select kind, count(distinct doc_id) as n from named_spans(TABLE(select * from chunk_text(TABLE(udtf_documents)))) group by kind having kind = 'PHRASE'").first().n
    assert n >= docs.filter("text is not null").count()


def test_text_to_query_reaches_them(spark, docs):
    listed = {r.function for r in textquery.functions_by_prefix(spark).collect()}
    assert {"chunk_text", "named_spans"} <= listed
    statement = "SELECT count(*) AS n FROM chunk_text(TABLE(udtf_documents))"
    assert textquery.read_only(statement) and textquery.verify(spark, statement).valid
    assert textquery.run_capped(spark, statement)[0][0]["n"] > 0
