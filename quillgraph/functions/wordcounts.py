"""Multiset intersections of word lists in Arrow batches."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sum((Counter(x.split(" ")) & Counter(y.split(" "))).values()) if x and y else 0 for x, y in zip(a, b)], dtype="int64")


def shared_words(a: Column, b: Column) -> Column:
    """How many words two texts of words between single spaces share, repeated ones as often as both have them."""
    return F.pandas_udf(_shared, "long")(a, b)
