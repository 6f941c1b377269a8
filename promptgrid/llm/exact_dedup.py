"""Exact deduplication against a history, through a minimal perfect hash.

``build_index`` turns the distinct digests of a history into shards of about ``SHARD_KEYS``. A shard is one row: the
bit vectors of a minimal perfect hash (a level's keys that collide with no other of the level get a bit; the rest go to
the next level; a key's slot is the rank of its bit) and, at each slot, the full SHA-256 digest and its winner's
locator, the document that stays. The index is a table, so it can be kept and used again for later batches.

``look_up`` reduces the new rows to their distinct digests, sends those to their shard, evaluates the hash for all of
them at once and compares all 32 bytes of the slot's digest: equal bytes are a member, anything else is none. Members
repeat the slot's winner; a nonmember's winner is the smallest id of its digest, as the nonmembers are grouped on their
own. The winners are joined back to the rows, those of hot digests, at most a thousand, by broadcast. A shard that gets
many more digests than it holds is asked in slices of about ``SHARD_KEYS``.

Texts are equal if their UTF-8 bytes are. Defined cases. Null text is no duplicate of anything; the empty text is a text
like others. Null ids lose against any id. Rows equal in id and text repeat each other: one stays. Extra columns pass
through. An empty history makes every row a nonmember. A string id that is no number fails the job in ANSI mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptgrid import storage
from promptgrid.llm import arrays, components

SHARD_KEYS = 50_000
#: Bits for each key that a level holds.
LOAD = 2

_U64 = np.uint64
_INDEX = "shard int, digests binary, winners array<long>, levels array<binary>"


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def _shard(of: Column, shards: int) -> Column:
    """The digest's last bytes, which the hash within a shard does not use."""
    return F.pmod(F.conv(F.hex(F.substring(of, 29, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _words(raw: bytes | np.ndarray, n: int) -> np.ndarray:
    """First 24 bytes of each digest, as three numbers."""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(n, 32)[:, :24]).view(_U64)


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Other bytes every eight levels, so that digests may agree in some."""
    return (arrays.mix64(words[:, level // 8 % 3] + _U64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % _U64(size)).astype(np.int64)


def build_hash(words: np.ndarray) -> list[np.ndarray]:
    """Bit vectors (as bytes of 0 and 1) of a minimal perfect hash over distinct rows of words."""
    levels: list[np.ndarray] = []
    while len(words):
        size = max(64, LOAD * len(words))
        at = _positions(words, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        words = words[~alone[at]]
        if len(levels) > 200:
            raise ValueError("two digests of a shard agree in their first 192 bits")
    return levels


def slots(words: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Each word's slot; -1 where no level has its bit (then it is no member; others may be no members either)."""
    out = np.full(len(words), -1, np.int64)
    left, base = np.arange(len(words)), 0
    for level, bits in enumerate(levels):
        at = _positions(words[left], level, len(bits))
        rank = np.cumsum(bits)
        hit = bits[at]
        out[left[hit]] = base + rank[at[hit]] - 1
        base += int(rank[-1])
        left = left[~hit]
    return out


def _build():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition holds whole shards, sorted by shard
        held: list[pa.RecordBatch] = []

        def finish(rows: pa.Table) -> pa.RecordBatch:
            n = rows.num_rows
            raw = b"".join(rows.column("digest").to_pylist())
            words = _words(raw, n)
            levels = build_hash(words)
            at = slots(words, levels)
            digests, winners = np.empty((n, 32), np.uint8), np.empty(n, np.int64)
            digests[at] = np.frombuffer(raw, np.uint8).reshape(n, 32)
            winners[at] = rows.column("winner").to_numpy()
            packed = [np.packbits(b).tobytes() + len(b).to_bytes(8, "little") for b in levels]
            return pa.RecordBatch.from_arrays(
                [rows.column("shard")[:1].combine_chunks(), pa.array([digests.tobytes()], pa.binary()), pa.array([winners.tolist()], pa.list_(pa.int64())), pa.array([packed], pa.list_(pa.binary()))],
                ["shard", "digests", "winners", "levels"],
            )

        for batch in batches:
            while batch.num_rows:
                shard = batch.column(0)[0].as_py()
                if held and held[0].column(0)[0].as_py() != shard:
                    yield finish(pa.Table.from_batches(held))
                    held = []
                same = int(np.searchsorted(batch.column(0).to_numpy(), shard, side="right"))
                held.append(batch.slice(0, same))
                batch = batch.slice(same)
        if held:
            yield finish(pa.Table.from_batches(held))

    return run


def build_index(history: DataFrame) -> tuple[DataFrame, int]:
    """(index table, number of shards) of the distinct texts of ``history`` (doc_id, text); the smallest id wins."""
    ids = history.where("text is not null").select(F.col("doc_id").cast("long").alias("winner"), digest().alias("digest"))
    distinct = storage.written(ids.groupBy("digest").agg(F.min("winner").alias("winner")), "digests")
    shards = max(1, -(-distinct.count() // SHARD_KEYS))
    rows = distinct.select(_shard(F.col("digest"), shards).alias("shard"), "digest", F.coalesce("winner", F.lit(np.iinfo(np.int64).max)).alias("winner"))
    index = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard").mapInArrow(_build(), _INDEX)
    index = storage.written(index, "digest-index")
    storage.delete(distinct)
    return index, shards


def _probe(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = rows[["digest", "least", "copies"]].assign(winner=rows["least"], member=False)
    if len(rows) and len(index):
        shard = index.iloc[0]
        n = len(shard["winners"])
        raw = b"".join(rows["digest"])
        levels = [np.unpackbits(np.frombuffer(b[:-8], np.uint8), count=int.from_bytes(b[-8:], "little")).astype(bool) for b in shard["levels"]]
        at = slots(_words(raw, len(rows)), levels)
        full = np.frombuffer(shard["digests"], np.uint8).reshape(n, 32)
        member = (at >= 0) & (full[at] == np.frombuffer(raw, np.uint8).reshape(-1, 32)).all(axis=1)
        out["member"] = member
        out["winner"] = np.where(member, np.asarray(shard["winners"], np.int64)[at], out["winner"])
    return out


def _winners(docs: DataFrame, index: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id and digest of each row whose text is not null; digest, least, copies, winner and member of each digest).

    ``least`` and ``winner`` are the largest long where there is no id.
    """
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))
    asked = rows.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(_NONE)).alias("least"), F.count("*").alias("copies"))
    asked = storage.written(asked.withColumn("shard", _shard(F.col("digest"), shards)), "asked")
    slices = max(1, -(-asked.count() // (shards * SHARD_KEYS)))
    sliced = asked.withColumn("slice", F.pmod(F.xxhash64("digest"), F.lit(slices)).cast("int"))
    spread = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    probed = sliced.groupBy("shard", "slice").cogroup(spread.groupBy("shard", "slice")).applyInPandas(_probe, "digest binary, least long, copies long, winner long, member boolean")
    return rows, storage.written(probed, "winners")


_NONE = int(np.iinfo(np.int64).max)


def look_up(docs: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(digest, doc_id, winner_doc_id, member, least) of each row of ``docs`` whose text is not null.

    A nonmember's winner is the smallest id of its digest among the nonmembers, which is ``least`` for any row.
    """
    rows, winners = _winners(docs, index, shards)
    joined = components.join_skewed(rows, winners, ["digest"], "copies", rows.count())
    return joined.select("digest", "doc_id", F.nullif(F.col("winner"), F.lit(_NONE)).alias("winner_doc_id"), "member", F.nullif(F.col("least"), F.lit(_NONE)).alias("least"))


def duplicates(docs: DataFrame, history: DataFrame | None = None, index: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(doc_id, winner_doc_id) of every row that goes, for the one that stays.

    Without ``history`` the history is ``docs`` itself, and a text's smallest id stays. With one, its documents are
    taken to be kept elsewhere, so every member goes. ``index``: that of the history, if it is there already.
    """
    found = look_up(docs, *(index or build_index(docs if history is None else history)))
    first = F.col("doc_id").eqNullSafe(F.col("least"))
    stays = first if history is None else first & ~F.col("member")
    # of rows equal in id and text one stays; copies under other ids all go
    turn = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("doc_id"))
    again = found.where(stays).withColumn("turn", turn).where("turn > 1").drop("turn")
    return found.where(~stays).unionByName(again).select("doc_id", "winner_doc_id")


def deduplicate(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows that ``duplicates`` finds; null texts stay.

    One shuffle of the rows, by digest and id: copies of one text under different ids spread over all tasks.
    """
    _, winners = _winners(docs, *build_index(docs if history is None else history))
    mine, ident, turn = (storage.fresh(docs, k) for k in ("digest", "ident", "turn"))
    stays = winners if history is None else winners.where("not member")
    stays = stays.select(F.col("digest").alias(mine), F.coalesce(F.nullif(F.col("least"), F.lit(_NONE)).cast("string"), F.lit("null")).alias(ident))
    rows = docs.where("text is not null").withColumns({mine: digest(), ident: F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))})
    same = Window.partitionBy(mine, ident).orderBy(mine)
    kept = rows.join(stays.hint("merge"), [mine, ident]).withColumn(turn, F.row_number().over(same)).where(F.col(turn) == 1)
    return kept.select(*docs.columns).unionByName(docs.where("text is null"))
