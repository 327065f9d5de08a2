"""Exact quantiles of large tables without one task that holds all values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quantiles(df: DataFrame, column: str, shares: list[float], most: int = 200_000) -> list[float | None]:
    """Linearly interpolated quantiles of a column's non-null values; null for none.

    Approximate quantiles bracket each wanted rank, and counts tell which ranks a bracket holds; brackets are
    narrowed until they hold at most `most` values, which are then sorted. A value that fills a bracket by itself
    is the answer. df is read several times, so it should be a table.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    n = values.count()
    if not n:
        return [None] * len(shares)
    out = []
    for share in shares:
        at = share * (n - 1)
        rank = int(at)
        low, high = _at_ranks(values, rank, min(rank + 1, n - 1), n, most)
        out.append(low + (high - low) * (at - rank))
    return out


def _at_ranks(values: DataFrame, first: int, second: int, n: int, most: int) -> tuple[float, float]:
    """The values at two neighbouring ranks of the sorted values."""
    low, high, below, inside = float("-inf"), float("inf"), 0, n
    while inside > most:
        some = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        share = (first - below) / max(1, inside - 1)
        near = [max(0.0, share - 0.002), min(1.0, share + 0.002)]
        a, b = some.agg(F.percentile_approx("v", near, 10_000)).first()[0]
        counted = some.agg(F.count_if(F.col("v") < a), F.count_if((F.col("v") >= a) & (F.col("v") <= b))).first()
        if not (below + counted[0] <= first and second < below + counted[0] + counted[1]):
            break  # the approximation was too coarse: sort the bracket as it is
        if (a, b) == (low, high):
            if a == b:
                return a, a
            break
        low, high, below, inside = a, b, below + counted[0], counted[1]
    ranked = values.filter((F.col("v") >= low) & (F.col("v") <= high)).orderBy("v").limit(second - below + 1).tail(second - first + 1)
    return ranked[0]["v"], ranked[-1]["v"]
