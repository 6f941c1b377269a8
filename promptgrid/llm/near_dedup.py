"""Near-duplicate removal by b-bit MinHash.

Every text becomes word shingles (arrays.py), their ``HASHES`` minima under linear permutations of the 32-bit
hashes, then

* ``BANDS`` keys of ``ROWS`` whole minima each, for candidates, and
* the lowest ``BITS`` bits of every minimum, packed into longs, for the estimate.

Keys that only one document has drop out in a shuffle of (key, document) pairs alone; the documents of the others meet
by key with their packed bits, where the similarity of a pair is read off by bit counts: if E is the share of equal
b-bit minima, J = (E - 2^-b) / (1 - 2^-b), which takes out chance collisions of low bits. A key's documents are linked
completely: pairs already connected need no further comparison, so a group of n near copies costs n comparisons, while
members outside the largest group are each compared with all. The links' connected components (alternating large and
small stars) are the groups.

Documents of equal signatures are one node before any key is made, so that exact copies, however many, meet nobody; at
the end every document finds its group by its signature, through a join that broadcasts the few hot ones.

Defined cases. Null ``doc_id``, null text and texts without a word (letters or digits) are in no group. A text of fewer
words than a shingle has one shingle. Letter case, ASCII punctuation and white space don't count; a character of U+3000 to
U+9FFF or beyond U+FFFF is a word of its own. A string id that is no number fails the job in ANSI mode. Rows that share a
``doc_id`` are one document: they stay or go together, and rows equal in id and text are kept once by ``deduplicate``.
The smallest id of a group stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptgrid import storage
from promptgrid.llm import arrays, components

SHINGLE_WORDS = 3
HASHES = 192
BITS = 2
ROWS = 4
#: A pair of similarity J shares no key with probability (1 - J^ROWS)^BANDS: 0.045 at the threshold, 0.0004 at 0.62.
BANDS = 48
THRESHOLD = 0.5
#: Pairs compared in one step.
PAIRS = 200_000

_U64 = np.uint64
_LOW = _U64(0x5555555555555555)
_LONGS = HASHES * BITS // 64
_SIG = [f"s{i}" for i in range(_LONGS)]


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draws = arrays.mix64(np.arange(1, 2 * HASHES + 1, dtype=_U64) * _U64(0x632BE59BD9B4E019))
    return (draws[:HASHES] >> _U64(32)).astype(np.uint32) | np.uint32(1), (draws[HASHES:] >> _U64(32)).astype(np.uint32)


def minima(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their HASHES minima as unsigned 32-bit)."""
    words, first = arrays.word_hashes(data, offsets)
    shingles, at = arrays.shingle_hashes(words, first, SHINGLE_WORDS)
    rows = np.flatnonzero(np.diff(at) > 0)
    if not len(rows):
        return rows, np.zeros((0, HASHES), np.uint32)
    short = (shingles >> _U64(32)).astype(np.uint32)
    starts, out = at[rows], np.empty((len(rows), HASHES), np.uint32)
    work = np.empty_like(short)
    for k, (a, b) in enumerate(zip(*_permutations(), strict=True)):
        np.multiply(short, a, out=work)
        np.add(work, b, out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return rows, out


def band_keys(least: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys a row; the band's number is part of the key."""
    keys = np.empty((len(least), BANDS), dtype=_U64)
    for band in range(BANDS):
        key = np.full(len(least), band + 1, dtype=_U64)
        for row in range(ROWS):
            key = arrays.mix64(key * _U64(0x9E3779B97F4A7C15) + least[:, band * ROWS + row])
        keys[:, band] = key
    return keys


def pack(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, 32 of them to a long."""
    low = (least & np.uint32(2**BITS - 1)).astype(_U64).reshape(len(least), _LONGS, 64 // BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=_U64) * _U64(BITS)), axis=2)


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of one packed signature with each of many."""
    differ = one ^ many
    differ = (differ | (differ >> _U64(1))) & _LOW
    equal = 1 - np.bitwise_count(differ).sum(axis=-1) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets, _ = arrays.utf8_parts(batch.column(1))
        for lo, hi in arrays.steps(offsets):
            rows, least = minima(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            packed, keys = pack(least).view(np.int64), band_keys(least).view(np.int64)
            ends = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
            columns = [pa.array(ids[lo:hi][rows].astype(np.int64)), *map(pa.array, packed.T), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_SIG, "keys"])


def _link(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in components.runs(batches):
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            keys, nodes, packed = rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2:]).view(_U64)

            def near(i: np.ndarray, j: np.ndarray, packed=packed) -> np.ndarray:
                parts = [slice(k, k + PAIRS) for k in range(0, len(i), PAIRS)]
                return np.concatenate([np.zeros(0), *(similarity(packed[i[p]], packed[j[p]]) for p in parts)])

            for a, b, value in components.linked_runs(components.run_numbers(keys), nodes, near, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(nodes[a], nodes[b])), pa.array(np.minimum(nodes[a], nodes[b])), pa.array(value)], ["a", "b", "similarity"])

    return run


def _signed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signature of every document that has one, distinct signatures with their least id and a number, ``node``)."""
    # letter case is folded in the JVM, whose table goes beyond ASCII
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).where("doc_id is not null and text is not null")
    signed = storage.written(rows.mapInArrow(arrays.tidy(_sign), "doc_id long, " + ", ".join(f"{s} long" for s in _SIG) + ", keys array<long>"), "signatures")
    distinct = signed.groupBy(*_SIG).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("keys").alias("keys"))
    return signed.drop("keys"), storage.written(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")


def links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity), a > b: links of nodes whose components are those of all candidate pairs at the threshold."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    met = keyed.mapInArrow(arrays.tidy(components.shared), "key long, node long").join(nodes.hint("merge").select("node", *_SIG), "node").select("key", "node", *_SIG)
    found = met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(arrays.tidy(_link(threshold)), "a long, b long, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _grouped(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, kept, similarity) of each signed row of a group that has another least id or a copy."""
    signed, nodes = _signed(docs)
    found = storage.written(links(nodes, threshold), "near-links")
    label = components.connected(found.select("a", "b").unionByName(components.versions(signed, nodes, _SIG)))
    best = found.select(F.explode(F.array("a", "b")).alias("node"), "similarity").groupBy("node").agg(F.max("similarity").alias("similarity"))
    groups = components.groups_of(nodes.select("node", *_SIG, "copies", "least"), label).join(best, "node", "left")
    # equal signatures estimate as 1
    groups = groups.withColumn("similarity", F.when(F.col("copies") > 1, 1.0).otherwise(F.col("similarity")))
    groups = storage.written(groups.where("copies > 1 or least <> group").select(*_SIG, "copies", F.col("group").alias("kept"), "similarity"), "groups")
    return components.join_skewed(signed, groups, _SIG, "copies", signed.count()).where("kept is not null").select("doc_id", "kept", "similarity")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id, similarity): each document that goes, the one that stays for it (the smallest id of its
    group), and its largest estimated similarity among the links of its group, 1 if its signature has copies."""
    gone = _grouped(docs, threshold).where("doc_id <> kept")
    return gone.groupBy("doc_id").agg(F.min("kept").alias("kept_doc_id"), F.max(F.coalesce("similarity", F.lit(1.0))).alias("similarity"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group; rows equal in id and text once, but null ids and texts all stay. One
    shuffle of the rows, by id."""
    gone = near_duplicates(docs, threshold).select(F.col("doc_id").alias(ident := storage.fresh(docs, "gone_id")))
    rank = storage.fresh(docs, "rank")
    whole = Window.partitionBy("doc_id", "text").orderBy("doc_id")
    bare = F.col("doc_id").isNull() | F.col("text").isNull()
    kept = docs.where(~bare).join(gone.hint("merge"), F.col("doc_id") == F.col(ident), "left_anti")
    return kept.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) == 1).drop(rank).unionByName(docs.where(bare))
