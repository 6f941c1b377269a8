"""Ordinals of rows, at any size and without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptgrid import storage


def numbered(rows: DataFrame, ordinal: str, key: str | None = None) -> DataFrame:
    """``rows`` with their ordinals from 0: in the order of ``key`` (nulls first, ties by a hash of the row), or else as
    scanned. Every row has one, whatever it repeats.

    The rows are written once with an id that holds their partition and place; the small table of the partitions' counts,
    a row a partition, gives the offsets.
    """
    place, part = storage.fresh(rows, "place"), storage.fresh(rows, "part")
    if key is not None:
        # the tie is part of the range, so that a key that many rows share is split
        plain = [F.col(f"`{f.name}`") if f.dataType.typeName() not in ("map", "variant") else F.to_json(f"`{f.name}`") for f in rows.schema.fields]
        tie = F.xxhash64(*plain)
        rows_ = rows.withColumn(part, tie).repartitionByRange(F.col(f"`{key}`"), F.col(part)).sortWithinPartitions(F.col(f"`{key}`"), F.col(part)).drop(part)
    else:
        rows_ = rows
    table = storage.written(rows_.withColumn(place, F.monotonically_increasing_id()), "ordinals")
    counts = table.groupBy(F.shiftright(place, 33).alias("part")).count().orderBy("part").collect()
    starts, at = [], 0
    for c in counts:
        starts.append((c["part"], at))
        at += c["count"]
    start = storage.fresh(table, "start")
    offsets = rows.sparkSession.createDataFrame(starts, f"{part} long, {start} long")
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    placed = table.withColumn(part, F.shiftright(place, 33)).join(F.broadcast(offsets), part)  # a row a partition
    return placed.withColumn(ordinal, F.col(start) + within).select(*(F.col(f"`{c}`") for c in rows.columns), ordinal)
