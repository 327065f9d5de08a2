"""Pairs of strings within two edits, by what is left of them when characters are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.storage import saved

MOST = 2


def deletions(text, most: int = MOST) -> Column:
    """All strings that are left of a text when up to `most` (0 to 2) of its characters are deleted, as an array."""
    if not 0 <= most <= 2:
        raise ValueError("up to two characters can be deleted")
    text, n = F.col(text) if isinstance(text, str) else text, F.length(text)
    whole = F.array(text)
    if not most:
        return whole
    cut = lambda i, j: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, j - i - 1), F.substring(text, j + 1, n))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    one = F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    if most == 1:
        return F.array_distinct(F.concat(whole, one))
    later = lambda i: F.when(i < n, F.sequence(i + 1, n)).otherwise(F.array().cast("array<int>"))
    two = F.flatten(F.transform(places, lambda i: F.transform(later(i), lambda j: cut(i, j))))
    return F.array_distinct(F.concat(whole, one, two))


def near_strings(texts: DataFrame, column: str, most: int = MOST) -> DataFrame:
    """a < b, distance: the distinct values of a column within `most` (up to 2) insertions, deletions and changes.

    If two strings are within d edits, deleting at most d characters from each leaves the same string. So pairs are
    those that share such a string, and only these are measured. Keys are 64-bit hashes of what is left; a key that
    strings share by chance is caught by the measure. Null values take no part.
    """
    values = texts.select(F.col(column).alias("s")).filter("s is not null").distinct()
    keys = saved(values.select("s", F.explode(F.array_distinct(F.transform(deletions("s", most), lambda x: F.xxhash64(x)))).alias("key")))
    # keys that one string has alone are no one's, and are most
    shared = keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "key", "left_semi")
    pairs = shared.select("key", F.col("s").alias("a")).join(shared.select("key", F.col("s").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", most)).filter("distance >= 0")
