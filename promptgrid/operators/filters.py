"""Row selection."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptgrid.config import Skip
from promptgrid.functions import hashing
from promptgrid.functions.text import strip


def length_between(df: DataFrame, column: str, least: int, most: int) -> DataFrame:
    """Rows whose stripped text has ``least`` to ``most`` characters, both included. Null counts as empty, and empty
    texts go whatever ``least`` is. A column that isn't there drops every row."""
    if column not in df.columns:
        warnings.warn(f"there is no column {column}, so every row is passed over", UserWarning, stacklevel=2)
        return df.where(F.lit(False))
    n = F.length(strip(F.col(column)))
    return df.where((F.col(column) != "") & (n >= least) & (n <= most))


def skip(df: DataFrame, rule: Skip | None) -> DataFrame:
    """Rows that ``rule`` doesn't pass over; a null verdict keeps the row."""
    if rule is None:
        return df
    if isinstance(rule, str):
        verdict = F.expr(rule)
    elif isinstance(rule, Column):
        verdict = rule
    else:

        return df.mapInArrow(_judged(rule), df.schema)
    return df.where(~F.coalesce(verdict, F.lit(False)))


def _judged(rule: Callable[[dict[str, Any]], bool]):
    """Arrow batches without the rows that a Python function passes over; it sees each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not rule(row) for row in batch.to_pylist()], pa.bool_()))

    return run


def among(df: DataFrame, column: str, values: list[Any], count: int | None = None, key: str | None = None, seed: int = 42) -> DataFrame:
    """Rows whose ``column`` is one of ``values``; of these, ``count`` picked by a seeded draw of ``key``, all if there are
    no more. Null is no member."""
    members = df.where(F.col(column).isin(list(values)) if values else F.lit(False))
    if count is None:
        return members
    if key is None:
        raise ValueError("a pick needs a key")
    # a top-k: each task keeps its own best, and one merges them
    return members.orderBy(hashing.digest(seed, F.col(key)), key).limit(count)


def head(df: DataFrame, count: int | None, *order: str) -> DataFrame:
    """The first ``count`` rows by ``order``; None is all, 0 none."""
    if count is None:
        return df
    return (df.orderBy(*order) if order else df).limit(count)


def has_context(df: DataFrame, column: str | None) -> Column:
    """Whether a row's context is text that isn't empty."""
    if column is None or column not in df.columns or dict(df.dtypes)[column] != "string":
        return F.lit(False)
    return F.coalesce(F.col(column) != "", F.lit(False))
