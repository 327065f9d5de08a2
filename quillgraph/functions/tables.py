"""Table functions for SQL: `chunk_text(TABLE(documents))` and `named_spans(TABLE(chunks))`."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from quillgraph.operators.chunking import split_sections, split_text


def _columns(row: AnalyzeArgument, *names: str) -> dict[str, T.DataType]:
    if not row.isTable:
        raise ValueError("the first argument is a table: TABLE(name) or TABLE(SELECT ...)")
    found = {f.name: f.dataType for f in row.dataType.fields}
    if lacking := [n for n in names if n not in found]:
        raise ValueError(f"the table has no column {', '.join(lacking)}")
    return found


def _constant(argument: AnalyzeArgument | None, name: str, default: int, least: int) -> int:
    if argument is None:
        return default
    if not argument.isConstantExpression or not isinstance(argument.value, int) or argument.value < least:
        raise ValueError(f"{name} is a constant of {least} or more")
    return argument.value


class ChunkText:
    """chunk_id, doc_id, index, section, text of every row with a text, as `chunking.chunks` gives them.

    Rows stay where they are. A null doc_id has a null chunk_id; further columns are not read.
    """

    @staticmethod
    def analyze(row: AnalyzeArgument, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None, sections: AnalyzeArgument = None) -> AnalyzeResult:
        kind = _columns(row, "doc_id", "text")["doc_id"]
        if _constant(overlap, "overlap", 200, 0) >= _constant(size, "size", 1000, 1):
            raise ValueError("overlap is smaller than size")
        text = T.StringType()
        schema = T.StructType().add("chunk_id", text).add("doc_id", kind).add("index", T.IntegerType()).add("section", text).add("text", text)
        return AnalyzeResult(schema, select=[SelectedColumn("doc_id"), SelectedColumn("text")])

    def eval(self, row, size: int = 1000, overlap: int = 200, sections: bool = False):
        key = row["doc_id"]
        found = split_sections(row["text"], size, overlap) if sections else [(None, c) for c in split_text(row["text"], size, overlap)]
        for i, (section, text) in enumerate(found):
            yield (None if key is None else f"{key}_chunk_{i}", key, i, section, text)


class NamedSpans:
    """doc_id, name, kind, first_chunk, n_chunks: what a document's chunks name, by the rules of `build.mentions`.

    The function has its rows by document, in order of chunk_id, whatever the caller writes, and keeps the names of
    one document at a time.
    """

    @staticmethod
    def analyze(row: AnalyzeArgument) -> AnalyzeResult:
        found = _columns(row, "doc_id", "chunk_id", "text")
        schema = T.StructType().add("doc_id", found["doc_id"]).add("name", T.StringType()).add("kind", T.StringType()).add("first_chunk", found["chunk_id"]).add("n_chunks", T.LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("chunk_id")], select=[SelectedColumn("doc_id"), SelectedColumn("chunk_id"), SelectedColumn("text")])

    def __init__(self):
        from quillgraph.plans.build import _CAPITALS, _QUOTED

        # a blank is an ASCII one for the JVM's patterns, the end of a word is Unicode's
        own = lambda pattern: re.compile(pattern.replace(r"\s", r"[ \t\n\x0b\f\r]"))
        self._rules = [("NAME", own(_CAPITALS), 0), ("PHRASE", own(_QUOTED), 1)]
        self._doc, self._names = None, {}

    def eval(self, row):
        self._doc, text = row["doc_id"], (row["text"] or "")[:8000]
        for kind, pattern, group in self._rules:
            for name in dict.fromkeys(m.group(group) for m in pattern.finditer(text)):
                first, n = self._names.get((name, kind), (row["chunk_id"], 0))
                self._names[name, kind] = (first, n + 1)

    def terminate(self):
        for (name, kind), (first, n) in self._names.items():
            yield (self._doc, name, kind, first, n)


FUNCTIONS = {"chunk_text": ChunkText, "named_spans": NamedSpans}


def registered(spark: SparkSession) -> list[str]:
    """Make the table functions known to a session's SQL; their names."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
    return sorted(FUNCTIONS)
