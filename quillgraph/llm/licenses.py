"""License scans with a positional index of rare words (native).

The notices below are indexed by word: (notice, place, weight). All places of a file's licence words are looked
up in that index, as a notice counts by its whole indexed weight; postings whose place in the file minus place in the notice agree support one alignment of
the notice. An alignment counts when its share of the notice's indexed weight is high enough and the file
holds one of the notice's mandatory key phrases. IDF comes from all documents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import written

#: A word, in a text whose A-Z are lower case.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: phrase: label. Fixed by the contract of the scan.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: (notice texts, key phrases of which one must stand in the file). Short public licence notices.
NOTICES = {
    "mit": (
        ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
        ["mit license", "permission is hereby granted free of charge"],
    ),
    "apache-2": (["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license apache"], ["apache license version 2"]),
    "gpl-3": (["this work is licensed under the gnu general public license version 3", "under the terms of the gnu general public license as published by the free software foundation either version 3"], ["gnu general public license version 3", "general public license as published by the free software foundation either version 3"]),
    "gpl-2": (["licensed under the gnu general public license version 2"], ["gnu general public license version 2"]),
    "lgpl-3": (["licensed under the gnu lesser general public license version 3"], ["gnu lesser general public license version 3"]),
    "agpl-3": (["licensed under the gnu affero general public license version 3"], ["gnu affero general public license version 3"]),
    "mpl-2": (["this source code form is subject to the terms of the mozilla public license v 2 0"], ["mozilla public license"]),
    "bsd": (["redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd license"], ["redistribution and use in source and binary forms", "bsd license"]),
    "isc": (["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license"], ["permission to use copy modify and or distribute", "isc license"]),
    "cc-by-nc": (["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"], ["cc by nc", "creative commons attribution noncommercial"]),
    "cc-by-sa": (["licensed under cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"], ["cc by sa", "creative commons attribution sharealike"]),
    "cc-by": (["licensed under cc by 4 0", "creative commons attribution 4 0 international license"], ["cc by 4 0", "creative commons attribution 4 0"]),
    "unlicense": (["this is free and unencumbered software released into the public domain"], ["free and unencumbered software"]),
}
#: Words too common in any prose to be worth a posting.
COMMON = frozenset("a and any are as by for in is it may not of on or the this to use under with without you 0 1 2 3 4 v".split())


def _index_rows() -> list[tuple[str, int, str, int]]:
    rows, notice = [], 0
    for label, (texts, _) in NOTICES.items():
        for text in texts:
            rows += [(label, notice, w, i) for i, w in enumerate(text.split()) if w not in COMMON]
            notice += 1
    return rows


VOCABULARY = sorted({w for _, _, w, _ in _index_rows()})
KEY_PHRASES = sorted({p for _, phrases in NOTICES.values() for p in phrases})
#: Words of which each notice and each key phrase has at least one: without them a file isn't looked at further.
ANCHORS = sorted({max((w for w in p.split() if w not in COMMON), key=lambda w: (w in "mit apache gnu mozilla bsd isc cc".split(), len(w), w)) for p in [*KEY_PHRASES, *BASE_PHRASES]})


def _placed(phrase: str) -> Column:
    """Word places where the phrase starts in `joined`, a text of words with one space around each."""
    gaps = F.split("joined", rf"(?<= ){re.escape(phrase)}(?= )", -1)
    before = F.transform(gaps, lambda g: F.size(F.split(g, " ", -1)) - 2)
    width = len(phrase.split())
    acc = F.named_struct(F.lit("at"), F.lit(0), F.lit("out"), F.array().cast("array<int>"))
    first = F.slice(before, 1, F.size(before) - 1)

    def step(a: Column, words: Column) -> Column:
        # a gap begins with the space that ends the last phrase, or that opens the text
        place = a["at"] + words
        return F.named_struct(F.lit("at"), place + width, F.lit("out"), F.concat(a["out"], F.array(place)))

    return F.when(F.col("joined").contains(f" {phrase} "), F.aggregate(first, acc, step, lambda a: a["out"])).otherwise(F.array().cast("array<int>"))


def tokenised(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One narrow row per file: n_words, distinct licence words, the base phrases' places, key phrases found, and
    licence words with places if an anchor is there.

    Lower-casing beyond A-Z changes no comparison, as every word compared is ASCII.
    """
    words = docs.select(F.col(key), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN), F.lit(0)).alias("words"))
    some = F.arrays_overlap("words", F.array(*map(F.lit, ANCHORS)))
    words = words.withColumn("some", some)
    words = words.withColumn("joined", F.when(F.col("some"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).otherwise(F.lit(" ")))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))), lambda h: h["word"].isin(*VOCABULARY))
    keys = F.array_compact(F.array(*[F.when(F.col("joined").contains(f" {p} "), F.lit(p)) for p in KEY_PHRASES]))
    return words.select(
        key,
        F.size("words").cast("long").alias("n_words"),
        F.array_intersect("words", F.array(*map(F.lit, VOCABULARY))).alias("distinct"),
        *[_placed(p).alias(f"at_{i}") for i, p in enumerate(BASE_PHRASES)],
        F.when(F.col("some"), hits).otherwise(F.array().cast("array<struct<word:string,place:int>>")).alias("hits"),
        keys.alias("keys"),
    )


def aligned(files: DataFrame, n_files: int, least: float = 0.7) -> DataFrame:
    """(rid, label, score): notices that a file holds by position, with the share of indexed weight that agrees.

    A file looks up all its licence word places; the index is the constant table of this module.
    """
    spark = files.sparkSession
    words = files.select("rid", F.explode("hits").alias("hit")).select("rid", "hit.word", "hit.place")
    # of all files, those without an anchor too
    df = files.select(F.explode("distinct").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(n_files + 1.0) / (F.coalesce(F.col("df"), F.lit(0)) + 1)) + F.lit(1.0)
    index = spark.createDataFrame(_index_rows(), "label string, notice int, word string, at int")
    index = index.join(F.broadcast(df), "word", "left").withColumn("idf", idf)
    mass = index.groupBy("notice").agg(F.sum("idf").alias("mass"))
    index = index.join(F.broadcast(mass), "notice").select("label", "notice", "word", "at", "idf", "mass")
    votes = words.join(F.broadcast(index), "word").groupBy("rid", "label", "notice", (F.col("place") - F.col("at")).alias("shift"))
    scored = votes.agg((F.sum("idf") / F.first("mass")).alias("score")).filter(F.col("score") >= least)
    return scored.groupBy("rid", "label").agg(F.max("score").alias("score"))


def scan_licenses(docs: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per input row.

    Null and empty texts have no words and score 0; rows repeated with one doc_id each get their row; an
    empty table gives none; other columns are ignored. A file with a base phrase scores 1.
    """
    files = written(tokenised(docs).withColumn("rid", F.monotonically_increasing_id()))
    required = files.sparkSession.createDataFrame([(k, p) for k, (_, ps) in NOTICES.items() for p in ps], "label string, key string")
    verified = files.select("rid", F.explode("keys").alias("key")).join(F.broadcast(required), "key").select("rid", "label").distinct()
    found = aligned(files, files.count(), least).join(verified, ["rid", "label"])
    found = found.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))
    places = F.array_sort(F.concat(*[f"at_{i}" for i in range(len(BASE_PHRASES))]))
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(v)) for i, v in enumerate(BASE_PHRASES.values())]))
    rows = files.select("rid", "doc_id", "n_words", places.alias("places"), F.array_sort(F.array_distinct(base)).alias("base")).join(found, "rid", "left")
    some = F.size("places") > 0
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.when(some, F.element_at("places", 1).cast("long")).alias("first_word"),
        F.when(some, F.element_at("places", -1).cast("long")).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(some, F.lit(1.0)).otherwise(F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )
