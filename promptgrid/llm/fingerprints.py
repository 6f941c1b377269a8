"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the text; where it is -1 modulo the block size a chunk ends. Each chunk gives
one of 64 characters, so the block size (3 * 2^k, chosen for 32 to 64 chunks) and the characters are the fingerprint. A
second signature, at twice the block size, lets texts of up to double length be compared.

Two signatures are compared where a block size is common to both documents, and only if they share seven characters in
a row there. The score is 100 less the edit distance's share of both lengths (insertion and deletion 1, substitution 2),
at small block sizes held down to what so few bytes can show; where that is less than the least score of a link, the
score counts as it was if it is ``SMALL_SCORE`` or more. ``similar`` finds the groups that all pairs of score
``LEAST_SCORE`` or more connect: every document is looked up by all its seven-grams, those that no other document has
drop out in the first shuffle, and in what is left only members not yet connected are compared, many pairs at a time.
Equal fingerprints are collapsed to one node first, so that copies cost nothing further.

Defined cases. Null text: null fingerprint, a group of its own. Empty text: block size 0, a group of its own, like every
text whose signature has fewer than seven characters. Null ids: a fingerprint, but no group. Runs of more than three
equal characters count as three in comparisons. Equal fingerprints are one group. Rows that share an id share a group,
and with them all that any of their texts is linked to. A string id that is no number fails the job in ANSI mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptgrid import storage
from promptgrid.llm import arrays, components

CHUNKS = 64
WINDOW = 7
LEAST_BLOCK = 3
LEAST_SCORE = 50
#: The least score before it is held down, where that would keep it below ``LEAST_SCORE`` even for equal signatures.
SMALL_SCORE = 70
#: Pairs scored in one step; some 700 bytes of working memory each.
PAIRS = 20_000
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

_U32, _U64 = np.uint32, np.uint64


def rolling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte; a row's window starts empty."""
    n = len(data)
    c = data.astype(_U32)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    h1, h2, h3 = c.copy(), c * _U32(WINDOW), c.copy()
    for k in range(1, WINDOW):
        back = np.zeros(n, _U32)
        back[k:] = c[:-k]
        back[place < k] = 0
        h1 += back
        h2 += back * _U32(WINDOW - k)
        h3 ^= back << _U32(5 * k)
    return h1 + h2 + h3


def _chunks(ends: np.ndarray, lo: int, hi: int, most: int, total: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Characters (0 to 63) of the chunks of one row; the last of ``most`` takes what is left."""
    ends = ends[: most - 1]
    if not len(ends) or ends[-1] != hi:
        ends = np.append(ends, hi)
    starts = np.concatenate([[lo], ends[:-1]])
    return (arrays.mix64((total[ends] - total[starts]) * down[starts]) >> _U64(58)).astype(np.uint8)


def signatures(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(block size, characters, characters at twice the block size) of each row; block size 0 for an empty one."""
    n = len(data)
    rolled = rolling(data, offsets)
    total = np.zeros(n + 1, _U64)
    np.cumsum((data.astype(_U64) + _U64(1)) * arrays._power("up", n), out=total[1:])
    down = arrays._power("down", n) if n else np.ones(1, _U64)
    out = []
    none = np.zeros(0, np.uint8)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if lo == hi:
            out.append((0, none, none))
            continue
        block = LEAST_BLOCK
        while block * CHUNKS < hi - lo:
            block *= 2
        part = rolled[lo:hi]
        while True:
            ends = np.flatnonzero(part % _U32(block) == _U32(block - 1))
            if block == LEAST_BLOCK or len(ends) >= CHUNKS // 2:
                break
            block //= 2
        wide = ends[part[ends] % _U32(2 * block) == _U32(2 * block - 1)]
        out.append((block, _chunks(ends + lo + 1, lo, hi, CHUNKS, total, down), _chunks(wide + lo + 1, lo, hi, CHUNKS // 2, total, down)))
    return out


def squeezed(signature: np.ndarray) -> np.ndarray:
    """A signature with runs of more than three equal characters cut to three."""
    keep = np.ones(len(signature), bool)
    keep[3:] = (signature[3:] != signature[2:-1]) | (signature[2:-1] != signature[1:-2]) | (signature[1:-2] != signature[:-3])
    return signature[keep]


def _grams(signature: np.ndarray, block: int) -> np.ndarray:
    """Keys of the distinct seven-grams of a squeezed signature at its block size."""
    n = len(signature) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64)
    code = np.zeros(n, _U64)
    for k in range(WINDOW):
        code = (code << _U64(6)) | signature[k : k + n].astype(_U64)
    return np.unique(arrays.mix64(code ^ (_U64(block.bit_length()) << _U64(42)))).view(np.int64)


def _matrix(signatures_: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(signatures_), CHUNKS), 64, np.uint8)
    for i, s in enumerate(signatures_):
        out[i, : len(s)] = s
    return out


def scores(one: np.ndarray, many: np.ndarray, block: np.ndarray | int, least: int | None = None) -> np.ndarray:
    """Scores of pairs of rows of two matrices of squeezed signatures, whose common seven characters are taken as given.

    With substitutions at 2 the edit distance is both lengths less twice the longest common subsequence, which is
    counted with one 64-bit word a pair. With ``least``, scores that could not reach it are held down only below
    ``SMALL_SCORE``.
    """
    n = len(one)
    pair = np.arange(n)
    mask = np.zeros((n, 65), _U64)
    for i in range(CHUNKS):
        mask[pair, one[:, i]] |= _U64(1 << i)
    mask[:, 64] = 0
    state = np.full(n, 2**64 - 1, _U64)
    for j in range(CHUNKS):
        hit = state & mask[pair, many[:, j]]
        state = (state + hit) | (state - hit)
    lengths = (one != 64).sum(axis=1), (many != 64).sum(axis=1)
    common = np.bitwise_count(~state).astype(np.int64)
    score = 200 * common // np.maximum(lengths[0] + lengths[1], 1)
    most = block // LEAST_BLOCK * np.minimum(*lengths)
    held = np.minimum(score, most)
    return held if least is None else np.where((most < least) & (score >= max(least, SMALL_SCORE)), score, held)


def compare(a: str, b: str) -> int:
    """Score of two fingerprints ``block:signature:signature``, 0 if no block size is common."""
    best = 0
    code = {int(c): i for i, c in enumerate(ALPHABET)}
    read = lambda s: squeezed(np.array([code[c] for c in s.encode()], np.uint8))
    (x, *p), (y, *q) = ([int(f.split(":")[0]), *f.split(":")[1:]] for f in (a, b))
    for i, s in enumerate(p):
        for j, t in enumerate(q):
            block = x << i
            if block == y << j and block:
                s_, t_ = read(s), read(t)
                if np.isin(_grams(s_, block), _grams(t_, block)).any():
                    best = max(best, int(scores(_matrix([s_]), _matrix([t_]), block, LEAST_SCORE)[0]))
    return best


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, valid = arrays.utf8_parts(batch.column(1))
        for lo, hi in arrays.steps(offsets):
            found = signatures(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            there = valid[lo:hi]
            texts = [[ALPHABET[s[k]].tobytes().decode() if ok else None for s, ok in zip(found, there, strict=True)] for k in (1, 2)]
            blocks = pa.array([s[0] if ok else None for s, ok in zip(found, there, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), blocks, *(pa.array(t, pa.string()) for t in texts)], ["doc_id", "block_size", "signature", "double_signature"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, block_size, signature, double_signature), a row for each row of ``docs``. No shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_print, "doc_id long, block_size long, signature string, double_signature string")


_CODE = np.zeros(256, np.uint8)
_CODE[ALPHABET] = np.arange(64)


def _squeezed_rows(column: pa.Array) -> np.ndarray:
    """The squeezed signatures of a string column as rows of 64 characters, 64 standing for none."""
    data, offsets, _ = arrays.utf8_parts(column)
    length = np.diff(offsets)
    at = offsets[:-1, None] + np.arange(CHUNKS)
    none = np.arange(CHUNKS) >= length[:, None]
    rows = _CODE[np.append(data, np.uint8(0))[np.where(none, len(data), at)]]
    rows[none] = 64
    same = (rows[:, 1:] == rows[:, :-1]) & ~none[:, 1:]
    for i in np.flatnonzero((same[:, 2:] & same[:, 1:-1] & same[:, :-2]).any(axis=1)).tolist():
        short = squeezed(rows[i, : length[i]])
        rows[i, : len(short)], rows[i, len(short) :] = short, 64
    return rows


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, which signature) of every seven-gram; a gram that a signature has twice comes twice."""
    for batch in batches:
        nodes, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        for k in range(2):
            rows = _squeezed_rows(batch.column(2 + k))
            code = np.zeros((len(rows), CHUNKS - WINDOW + 1), _U64)
            for j in range(WINDOW):
                code = (code << _U64(6)) | rows[:, j : j + code.shape[1]].astype(_U64)
            there = rows[:, WINDOW - 1 :] != 64
            size = np.log2(np.maximum(blocks, 1) // LEAST_BLOCK + (blocks == 0)).astype(_U64) + _U64(k)
            keys = arrays.mix64(code ^ (size[:, None] << _U64(42)))[there].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(nodes, there.sum(axis=1))), pa.array(np.full(len(keys), k, np.int8))], ["key", "node", "which"])


def _match(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in components.runs(batches):
            keys, nodes, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            rows = _squeezed_rows(batch.column(3))

            def score(i: np.ndarray, j: np.ndarray, rows=rows, blocks=blocks) -> np.ndarray:
                parts = [slice(k, k + PAIRS) for k in range(0, len(i), PAIRS)]
                return np.concatenate([np.zeros(0, np.int64), *(scores(rows[i[p]], rows[j[p]], blocks[i[p]], least) for p in parts)])

            for a, b, value in components.linked_runs(components.run_numbers(keys), nodes, score, least):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(nodes[a], nodes[b])), pa.array(np.minimum(nodes[a], nodes[b])), pa.array(value)], ["a", "b", "score"])

    return run


_PRINT = ["block_size", "signature", "double_signature"]


def similar(docs: DataFrame, least_score: int = LEAST_SCORE) -> DataFrame:
    """(doc_id, block_size, signature, double_signature, group_doc_id): ``fingerprints`` with the smallest id of each
    document's group."""
    table = storage.written(fingerprints(docs), "prints")
    able = F.length("signature") >= WINDOW
    named = table.where("doc_id is not null")
    distinct = named.where(able).groupBy(*_PRINT).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = storage.written(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    grams = nodes.select("node", *_PRINT).mapInArrow(arrays.tidy(_index), "key long, node long, which tinyint")
    shared = grams.repartition("key").sortWithinPartitions("key", "node").mapInArrow(components.shared, "key long, node long, which tinyint")
    at = F.when(F.col("which") == 0, F.col("signature")).otherwise(F.col("double_signature"))
    full = shared.join(nodes.hint("merge"), "node").select("key", "node", F.expr("shiftleft(block_size, which)").alias("block"), at.alias("s"))
    links = full.repartition("key").sortWithinPartitions("key", "node").mapInArrow(arrays.tidy(_match(least_score)), "a long, b long, score long")
    label = components.connected(links.select("a", "b").unionByName(components.versions(named.where(able), nodes, _PRINT)))
    groups = components.groups_of(nodes, label).select(*_PRINT, "copies", "group")
    grouped = components.join_skewed(table, storage.written(groups, "groups"), _PRINT, "copies", table.count())
    # the versions of an id that are too short to compare go with its others
    short = named.where(~able).select("doc_id").distinct()
    mine = storage.written(named.where(able).join(short, "doc_id", "left_semi").join(groups, _PRINT).groupBy("doc_id").agg(F.min("group").alias("own")), "short")
    out = grouped.withColumn("own", F.lit(None).cast("long")) if mine.isEmpty() else grouped.join(mine, "doc_id", "left")
    return out.select("doc_id", *_PRINT, F.when(F.col("doc_id").isNotNull(), F.coalesce("own", "group", "doc_id")).alias("group_doc_id"))
