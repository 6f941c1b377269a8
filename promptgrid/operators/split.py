"""Exact, seeded splits and orders."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptgrid.functions import hashing
from promptgrid.operators.order import numbered

#: Rows of a range of the hash that is ranked on its own, and the most such ranges, whose counts are broadcast.
RANGE_ROWS = 50_000
MOST_RANGES = 1 << 16


def ranked(df: DataFrame, key: str, seed: int, rank: str = "rank", n: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) in the seeded hash order of its key, ties by the key itself.

    Rows are ranked within ranges of the hash, in parallel; a small table of the ranges' counts gives each its offset.
    n: the number of rows, if it is known.
    """
    ranges = min(MOST_RANGES, max(1, -(-(df.count() if n is None else n) // RANGE_ROWS)))
    hashed = df.withColumns({"_h": hashing.digest(seed, F.col(key)), "_b": F.floor(hashing.draw(seed, F.col(key)) * F.lit(ranges) / F.lit(2**32)).cast("int")})
    counts = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    # at most MOST_RANGES rows, whatever the input
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return hashed.withColumn("_r", place).join(F.broadcast(offsets), "_b").withColumn(rank, F.col("_o") + F.col("_r")).select(*df.columns, rank)


def train_test(df: DataFrame, train_size: float, key: str, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """``df`` with ``split``: exactly ``floor(n * train_size)`` rows train, at least one of either kind if n > 1."""
    if not 0 < train_size < 1:
        raise ValueError("train_size must lie between 0 and 1")
    n = df.count()
    train = n - math.ceil(n * (1 - train_size) - 1e-9)
    if shuffle:
        placed = ranked(df, key, seed, "_rank", n)
    else:
        placed = numbered(df, "_rank", key).withColumn("_rank", F.col("_rank") + 1)
    return placed.withColumn("split", F.when(F.col("_rank") <= train, "train").otherwise("test")).drop("_rank")
