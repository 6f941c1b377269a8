"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptgrid import storage


def linked_runs(run: np.ndarray, ids: np.ndarray, score: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(member, other member, score) of links that connect, within each run, exactly what all its pairs of a score of
    at least ``least`` would connect.

    ``run``: the run of each row, from 0, in ascending order; ``score(i, j)``: scores of pairs of rows. In each round one
    member of every run that is not settled yet is compared with all others of it, for all runs at once. Members already
    in one group need no comparison with each other: a run of n alike costs n comparisons, and then every member outside
    its largest group is compared with all. Rows of equal ``ids`` are one member.
    """
    n = len(run)
    if not n:
        return
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.append(start, n))
    group, done = np.arange(n), np.zeros(n, bool)
    turn = np.flatnonzero(size > 1)
    pivots = start[turn]
    while len(turn):
        j = _ranges(start[turn], size[turn])
        i = np.repeat(pivots, size[turn])
        other = ids[i] != ids[j]
        i, j = i[other], j[other]
        value = score(i, j)
        hit = value >= least
        if hit.any():
            yield j[hit], i[hit], value[hit]
        done[pivots] = True
        # the groups of all that were hit become the pivot's; rows equal in id need no link
        rows = _ranges(start[turn], size[turn])
        of = np.repeat(pivots, size[turn])
        joins = np.zeros(n, bool)
        joins[group[j[hit]]] = True
        joins[group[rows[ids[rows] == ids[of]]]] = True
        joined = joins[group[rows]]
        group[rows[joined]] = group[of[joined]]
        # the next of each run that is neither done nor in its run's largest group
        members = np.bincount(group[rows], minlength=n)
        best = np.maximum.reduceat(members[group[rows]], np.cumsum(size[turn]) - size[turn])
        large = members[group[rows]] == np.repeat(best, size[turn])
        # one largest group of several that are as large
        place = np.repeat(np.arange(len(turn)), size[turn])
        chosen = np.full(len(turn), n)
        np.minimum.at(chosen, place[large], group[rows[large]])
        rest = ~done[rows] & (group[rows] != chosen[place])
        following, first = np.unique(place[rest], return_index=True)
        turn, pivots = turn[following], rows[rest][first]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, size), one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def run_numbers(keys: np.ndarray) -> np.ndarray:
    """The number, from 0, of the run of equal keys that each row is in."""
    return np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole runs of rows with an equal first column, from batches sorted by it: each batch out holds whole runs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and held and held[0].column(0)[0].as_py() == keys[0]:
            held.append(batch)
            continue
        yield from (b for b in pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches() if b.num_rows)
        held = [batch.slice(last)]
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows (key, node) of keys that two nodes or more have, from batches sorted by both.

    Of a key that goes on from batch to batch one row is held at most, so that a hot key needs no memory.
    """
    held: pa.RecordBatch | None = None
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        keys, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        fresh = held is not None or last is None
        repeat = np.concatenate([[not fresh and last == (keys[0], nodes[0])], (keys[1:] == keys[:-1]) & (nodes[1:] == nodes[:-1])])
        batch = batch.filter(pa.array(~repeat))
        keys, nodes = keys[~repeat], nodes[~repeat]
        held = None
        if not len(keys):
            continue
        same = np.concatenate([[not fresh and last[0] == keys[0]], keys[1:] == keys[:-1]])
        several = same | np.append(same[1:], False)
        if not several[-1]:
            held = batch.slice(batch.num_rows - 1)
        last = (keys[-1], nodes[-1])
        if several.any():
            yield batch.filter(pa.array(several))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a > b).

    Large star: every neighbour above a node is linked to the least of the node and its neighbours. Small star: every
    neighbour below a node, and the node, are linked to the least of them.
    """
    both = edges if not large else edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a").withColumn("m", F.least("a", "m"))
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): the least node of its component.

    Each round writes its edges to the shared folder, so that a lost executor costs at most one round. It ends when a
    round changes nothing: every edge then points at its component's least node.
    """
    edges = storage.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        after = storage.written(_star(_star(edges, True), False), "edges")
        storage.delete(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def groups_of(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """``nodes`` (node, least, ...) with ``group``, the smallest ``least`` of each one's component."""
    labelled = nodes.join(storage.written(label, "labels"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    return labelled.join(labelled.groupBy("label").agg(F.min("least").alias("group")), "label").drop("label")


def versions(rows: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b) between the nodes of one ``doc_id``; keys: the columns of ``rows`` and ``nodes`` that make a node."""
    mark = F.xxhash64(*keys)
    several = storage.written(rows.groupBy("doc_id").agg(F.min(mark).alias("p"), F.max(mark).alias("q")).where("p <> q").select("doc_id"), "several")
    if several.isEmpty():
        return rows.sparkSession.createDataFrame([], "a long, b long")
    own = storage.written(rows.join(several, "doc_id").select("doc_id", *keys).distinct().join(nodes.select("node", *keys), keys).select("doc_id", "node"), "versions")
    least = own.groupBy("doc_id").agg(F.min("node").alias("b"))
    return own.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


#: A key is hot if it has more than this share of the rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


def join_skewed(rows: DataFrame, values: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``values``, one row a key, whose column ``count`` has the rows of its key.

    Hot keys, of which there are at most 1 / HOT_SHARE whatever the data, are broadcast. Then all rows meet the other keys,
    none of which has more than ``HOT_SHARE`` of the ``total`` rows, in one shuffle, which spreads the rows of hot keys,
    done by now, by a hash of themselves.
    """
    least = max(1, int(total * HOT_SHARE))
    extra = [c for c in values.columns if c not in (*keys, count)]
    hot = values.where(F.col(count) > least).select(*keys, *(F.col(c).alias(f"_hot_{c}") for c in extra), F.lit(True).alias("_hot"))
    # a zero that the optimizer doesn't know to be one: a literal would drop out of the join's keys
    rest = values.where(F.col(count) <= least).select(*keys, *extra, (F.col(count) * F.lit(0)).cast("long").alias("_salt"))
    salt = F.when(F.col("_hot"), F.xxhash64(*rows.columns).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
    joined = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(rest, [*keys, "_salt"], "left")
    return joined.select(*rows.columns, *(F.coalesce(c, f"_hot_{c}").alias(c) for c in extra))
