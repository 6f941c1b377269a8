"""Whole-batch text primitives on Arrow buffers: no Python object per row, word or shingle."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one vectorised step handles; a longer document forms a step of its own. Some fifty bytes of working
#: memory a text byte are needed at once.
STEP_BYTES = 500_000

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes that belong to words: ASCII letters and digits, and every byte of a multi-byte character.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[ord("0") : ord("9") + 1] = True
WORD_BYTE[ord("a") : ord("z") + 1] = True
WORD_BYTE[ord("A") : ord("Z") + 1] = True
WORD_BYTE[128:] = True

_tables: dict[str, np.ndarray] = {}
_powers = {"up": np.ones(1, dtype=_U64), "down": np.ones(1, dtype=_U64)}


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 rows, validity) of a string column; a null row is empty."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    return raw[at[0] : at[-1]], at - at[0], valid


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, first of each row with their number at the end); bytes that are no UTF-8 are U+FFFD."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        rows = [np.frombuffer(raw[a:b].decode(errors="replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.cumsum([0, *map(len, rows)])
    if len(points) == len(data):
        return points, offsets
    begun = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begun[1:])
    return points, begun[offsets]


def _table(name: str, kind: type, of: Callable[[int], int]) -> np.ndarray:
    if name not in _tables:
        _tables[name] = np.fromiter(map(of, range(0x110000)), kind, 0x110000)
    return _tables[name]


def is_letter() -> np.ndarray:
    """By code point, ``str.isalpha``."""
    return _table("letter", bool, lambda i: chr(i).isalpha())


def is_space() -> np.ndarray:
    """By code point, ``str.isspace``."""
    return _table("space", bool, lambda i: chr(i).isspace())


def lower() -> np.ndarray:
    """By code point, ``str.lower`` where that is one code point, else itself."""
    return _table("lower", np.uint32, lambda i: ord(c) if len(c := chr(i).lower()) == 1 else i)


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text is at most ``limit`` bytes, or one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which stays for later tasks, gives memory it does not use back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Memory that isn't used goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # a C library without it
    _trim = None


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values (constants of SplitMix64)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        factor = np.full(max(n, STEP_BYTES + 1), _BASE if kind == "up" else _INVERSE, dtype=_U64)
        factor[0] = 1
        _powers[kind] = np.multiply.accumulate(factor)
    return _powers[kind][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every maximal run of word bytes; a run never crosses a row.

    A character of U+3000 to U+9FFF or beyond U+FFFF is a run of its own: scripts without spaces go by characters.
    """
    word = WORD_BYTE[data]
    alone = np.zeros(len(data) + 1, bool)
    for leads, width in (((data >= 0xE3) & (data <= 0xE9), 3), (data >= 0xF0, 4)):
        at = np.flatnonzero(leads)
        alone[at] = True
        alone[np.minimum(at + width, len(data))] = True
    inside = offsets[1:-1]
    inside = inside[(inside > 0) & (inside < len(data))]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    before[inside] = False
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    after[inside - 1] = False
    return np.flatnonzero(word & (~before | alone[:-1])), np.flatnonzero(word & (~after | alone[1:])) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word in order, first word of each row with the total at the end)."""
    start, end = word_spans(data, offsets)
    n = len(data)
    total = np.zeros(n + 1, dtype=_U64)
    np.cumsum((data.astype(_U64) + _U64(1)) * _power("up", n), out=total[1:])
    hashes = mix64((total[end] - total[start]) * _power("down", n)[start] if len(start) else np.zeros(0, _U64))
    return hashes, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each run of ``width`` words, first shingle of each row with the total at the end).

    A row of fewer words has one shingle, of all its words; a row without words has none.
    """
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(len(words))
    mixed = np.zeros(len(words), dtype=_U64)
    for k in range(width):
        part = np.zeros(len(words), dtype=_U64)
        part[: len(words) - k] = words[k:] if k else words
        mixed += np.where(left > k, mix64(part + _U64(k + 1)) * _U64(2 * k + 1), _U64(0))
    opening = np.zeros(len(words), bool)
    opening[first[:-1][counts > 0]] = True
    keep = (left >= width) | opening
    position = np.zeros(len(words) + 1, np.int64)
    np.cumsum(keep, out=position[1:])
    return mix64(mixed[keep]), position[first]
