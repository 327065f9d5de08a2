"""Running sums and sequential budget laws over long sequences, block by block.

A sequence is cut into blocks of neighbouring rows by a range partitioning. What a law does to a whole block
depends on what comes before only through how much of the budget is used then: a number from 0 to the budget. So
every block says, for each such number, what is used after it, the blocks' answers are chained, and each block is
then gone through once more from where it really begins. No task holds more than a block, or a line a block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.storage import saved


def blocked(rows: DataFrame, per: list[str], order: list[Column]) -> DataFrame:
    """rows written with `_block`, their place in a range partitioning by group and order."""
    return saved(rows.repartitionByRange(*[F.col(c) for c in per], *order).withColumn("_block", F.spark_partition_id()))


def running_sums(rows: DataFrame, value: str, per: list[str], order: list[Column], out: str = "running") -> DataFrame:
    """rows with the sum of `value` from the group's first row to each row, in an order without ties.

    Sums run within blocks; a block's offset is a sum over the totals of the blocks before it.
    """
    b = blocked(rows, per, order)
    totals = b.groupBy(*per, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*per).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_{c}") for c in per], F.col("_block").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    same = F.col("_block") == F.col("_at")
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = Window.partitionBy(*per, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = b.withColumn("_inside", F.sum(value).over(inside))
    return summed.join(totals, same).withColumn(out, F.col("_base") + F.col("_inside")).drop("_base", "_inside", "_at", "_block", *[f"_{c}" for c in per])


def _step(used: np.ndarray, size: int, budget: int, law: str) -> tuple[np.ndarray, np.ndarray]:
    """What is used after a row of `size` tokens, and whether the row opens a bin. budget + 1 stands for more than
    the budget, budget + 2 for no row yet."""
    total = used + size
    fits = (total <= budget) & (used <= budget)
    if law == "skip":
        return np.where(fits, total, used), np.zeros(len(used), dtype=np.int64)
    alone = min(size, budget + 1)
    begins = used == budget + 2
    return np.where(fits, total, alone), (~fits & ~begins).astype(np.int64)


def _lines(ends: np.ndarray, opened: np.ndarray) -> bytes:
    """Both arrays, of which most neighbours are equal, compressed."""
    return zlib.compress(ends.astype("<i8").tobytes() + opened.astype("<i8").tobytes(), 1)


def budget_fold(rows: DataFrame, budget: int, order: str, tokens: str, law: str, per: str) -> DataFrame:
    """The sequential laws by group: `skip` leaves out what doesn't fit and goes on, `bins` opens a new bin when the
    last one overflows. per, order, tokens, bin (0 for skip): the rows taken. A row above the budget is never taken
    by `skip` and has a bin of its own in `bins`; order has no ties within a group."""
    if law not in ("skip", "bins"):
        raise ValueError(f"unknown law {law!r}")
    states = budget + 3
    begin = 0 if law == "skip" else budget + 2
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    b = blocked(rows.select(per, order, F.col(tokens).cast("long").alias(tokens)), [per], [F.col(order)])
    group = f"`{per}` {kinds[per]}, `_block` int"

    def through(key, pdf: pd.DataFrame) -> pd.DataFrame:
        now, place, opened = np.arange(states), np.arange(states), np.zeros(states, dtype=np.int64)
        sums = np.zeros(states, dtype=np.int64)
        for i, size in enumerate(pdf.sort_values(order)[tokens].tolist()):
            now, new = _step(now, size, budget, law)
            sums += new[place]
            if i % 16 == 15 or len(now) > 64:  # begun differently, soon the same
                now, back = np.unique(now, return_inverse=True)
                place = back[place]
        opened += sums
        return pd.DataFrame({per: [key[0]], "_block": [key[1]], "line": [_lines(now[place], opened)]})

    def chained(key, pdf: pd.DataFrame) -> pd.DataFrame:
        used, number, out = begin, 0, []
        for at, line in sorted(zip(pdf["_block"], pdf["line"])):
            out.append((key[0], at, used, number))
            ends, opened = np.frombuffer(zlib.decompress(line), dtype="<i8").reshape(2, states)
            used, number = int(ends[used]), number + int(opened[used])
        return pd.DataFrame(out, columns=[per, "_block", "used", "number"])

    def taken(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        used, number, out = np.array([right["used"].iloc[0]]), int(right["number"].iloc[0]), []
        left = left.sort_values(order)
        for o, size in zip(left[order].tolist(), left[tokens].tolist()):
            before = used
            used, new = _step(used, size, budget, law)
            number += int(new[0])
            if law == "bins" or before[0] + size <= budget:
                out.append((key[0], o, size, number))
        return pd.DataFrame(out, columns=[per, order, tokens, "bin"])

    lines = saved(b.groupBy(per, "_block").applyInPandas(through, f"{group}, line binary"))
    starts = lines.groupBy(per).applyInPandas(chained, f"{group}, used long, number long")
    both = b.groupBy(per, "_block").cogroup(starts.groupBy(per, "_block"))
    return both.applyInPandas(taken, f"`{per}` {kinds[per]}, `{order}` {kinds[order]}, `{tokens}` long, bin int")
