"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text's encoding is built from its halves: pieces of ``LEAF_CHARS`` or less are encoded outright, and two neighbours
are joined by re-encoding a window around their border. The window grows, by doubling, until each of its ends lies at a
stable place (or at the end of the piece): after a letter before any other kind of character, after a digit before any
other kind, and after punctuation other than an apostrophe before a letter, digit or white space. No pre-token of the
public pattern below spans such a place and no match before it looks past it, so merges left and right of it are the same
in any context: the tokens outside the window are proven stable and stay, those inside are replaced. The join is
associative, so a text may be cut anywhere; where the middle of a piece has no stable place near, as in a long run of
letters, the piece is cut at the stable place nearest to it, and a piece without any is encoded outright, so that no
part is encoded again and again. Kinds of characters are read off the tokenizer's own engine. Decoding concatenates the
bytes of halves up the same kind of tree and reads UTF-8 at the root, as a token may hold part of a character.

Defined cases. Null text: null tokens. Empty text: no tokens. Special tokens' strings are ordinary text. Decoding ids
outside the vocabulary raises; bytes that are no UTF-8 decode to U+FFFD. Ids are cast to long; a string that is no number
fails the job in ANSI mode. Extra columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptgrid.llm import arrays

#: A rank file: base64 of the token's bytes and its rank a line. It must lie at the same path on every executor.
VOCABULARY = os.environ.get("PROMPTGRID_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-token pattern that goes with the public 50k vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 4096
LEAF_TOKENS = 8192
#: Tokens decoded in one step.
STEP_TOKENS = 32 * LEAF_TOKENS
WINDOW_CHARS = 32
#: How far from the middle of a piece a stable place is sought before the cut moves to it.
NEAR_CHARS = 1024

_stable: list[re.Pattern[str]] = []
_loaded: dict[str, Codec] = {}


def _class(pattern: str) -> str:
    """A character class for ``re`` of what one character of the tokenizer's pattern language matches."""
    bytewise = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    matched = np.frombuffer(bytes(bytewise.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)
    begin = np.flatnonzero(np.diff(matched, prepend=matched[0]) != 1)
    last = matched[np.append(begin[1:], len(matched)) - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(matched[begin].tolist(), last.tolist(), strict=True))


def stable() -> re.Pattern[str]:
    """Matches the character before a stable place."""
    if not _stable:
        letter, digit, space = _class(r"\p{L}"), _class(r"\p{N}"), _class(r"\s")
        _stable.append(re.compile(f"[{letter}](?=[^{letter}])|[{digit}](?=[^{digit}])|[^'{space}{letter}{digit}](?=[{space}{letter}{digit}])"))
    return _stable[0]


class Codec:
    """One vocabulary: plain encoding, and the tree above it."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)
        self._width = self.widths.tolist()
        #: all tokens' bytes in the order of their ranks, and where each begins
        self._flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        self._start = np.cumsum(self.widths, dtype=np.int64) - self.widths
        self.stable = stable()

    @staticmethod
    def of(vocabulary: str) -> Codec:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = Codec(vocabulary)
        return _loaded[vocabulary]

    def encode(self, text: str, leaf: int = LEAF_CHARS) -> list[int]:
        return self._encode(text, 0, len(text), max(leaf, 1))

    def _encode(self, text: str, lo: int, hi: int, leaf: int) -> list[int]:
        if hi - lo <= leaf:
            return self.plain.encode_ordinary(text[lo:hi])
        mid = self._middle(text, lo, hi)
        if mid is None:
            return self.plain.encode_ordinary(text[lo:hi])
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid, leaf), self._encode(text, mid, hi, leaf))

    def _middle(self, text: str, lo: int, hi: int) -> int | None:
        """Where a piece is cut: in the middle, or at the stable place nearest to it if there is none near; None without any."""
        mid = (lo + hi) // 2
        near = min(NEAR_CHARS, (hi - lo) // 2)
        if stable_before(text, mid - near, mid) > mid - near and stable_after(text, mid, min(hi, mid + near)) < min(hi, mid + near):
            return mid
        places = [p for p in (stable_before(text, lo, mid), stable_after(text, mid, hi)) if lo < p < hi]
        return min(places, key=lambda p: abs(p - mid)) if places else None

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        if self.stable.match(text, mid - 1, mid + 1):
            return left + right
        begin, end = stable_before(text, lo, mid), stable_after(text, mid, hi)
        cut, drop = len(left), 0
        surplus = len(text[begin:mid].encode())
        while surplus > 0:
            cut -= 1
            surplus -= self._width[left[cut]]
        missing = len(text[mid:end].encode())
        while missing > 0:
            missing -= self._width[right[drop]]
            drop += 1
        if surplus or missing:
            raise AssertionError("a stable place lies inside a token")
        return left[:cut] + self.plain.encode_ordinary(text[begin:end]) + right[drop:]

    def decode(self, tokens: list[int] | np.ndarray) -> str:
        return self._bytes(np.asarray(tokens, np.int64), 0, len(tokens)).decode(errors="replace")

    def _bytes(self, tokens: np.ndarray, lo: int, hi: int) -> bytes:
        if hi - lo <= LEAF_TOKENS:
            return self.gather(tokens[lo:hi])[0].tobytes()
        mid = (lo + hi) // 2
        return self._bytes(tokens, lo, mid) + self._bytes(tokens, mid, hi)

    def gather(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the tokens' bytes, where each ends)."""
        if len(tokens) and (tokens.min() < 0 or tokens.max() >= len(self.widths)):
            raise KeyError("token ids outside the vocabulary")
        width = self.widths[tokens]
        if not width.all():
            raise KeyError("token ids outside the vocabulary")
        ends = np.cumsum(width, dtype=np.int64)
        at = np.repeat(self._start[tokens] - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)
        return self._flat[at], ends


def stable_before(text: str, lo: int, mid: int) -> int:
    """The last stable place before ``mid``, sought in windows that double; ``lo`` if there is none."""
    width = WINDOW_CHARS
    while True:
        at = max(lo, mid - width)
        places = [m.end() for m in stable().finditer(text, at, mid)]
        if places:
            return places[-1]
        if at == lo:
            return lo
        width *= 2


def stable_after(text: str, mid: int, hi: int) -> int:
    """The first stable place after ``mid``, sought in windows that double; ``hi`` if there is none."""
    width = WINDOW_CHARS
    while True:
        at = min(hi, mid + width)
        place = stable().search(text, mid, at)
        if place and place.end() < at:
            return place.end()
        if at == hi:
            return hi
        width *= 2


def _encoder(vocabulary: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for batch in batches:
            _, offsets, _ = arrays.utf8_parts(batch.column(1))
            for lo, hi in arrays.steps(offsets):
                ids, texts = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                tokens = [np.array(codec.encode(t.as_py(), leaf), np.int32) if t.is_valid else None for t in texts]
                yield pa.RecordBatch.from_arrays([ids, _lists(tokens), pa.array([None if t is None else len(t) for t in tokens], pa.int64())], ["doc_id", "token_ids", "n_tokens"])

    return run


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)])
    values = np.concatenate([np.zeros(0, np.int32), *(r for r in rows if r is not None)])
    missing = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()), mask=missing)


def _texts(codec: Codec, lists: pa.ListArray) -> pa.Array:
    """The texts of short token lists, their leaves gathered together."""
    offsets = lists.offsets.to_numpy()
    tokens = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    data, ends = codec.gather(tokens)
    at = np.concatenate([[0], ends])[offsets - offsets[0]]
    raw = data.tobytes()
    try:
        raw.decode()
        whole = not (data[at[:-1][at[:-1] < len(data)]] & 0xC0 == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if not whole:  # some row begins or ends within a character, or isn't UTF-8
        return pa.array([raw[a:b].decode(errors="replace") if ok else None for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), lists.is_valid().to_pylist(), strict=True)], pa.string())
    mask = None if not lists.null_count else pa.array(np.asarray(lists.is_valid())).buffers()[1]
    return pa.StringArray.from_buffers(len(lists), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw), mask, lists.null_count)


def _decoder(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            row = 0
            while row < batch.num_rows:
                # long lists go up the tree one by one, short ones together
                n = 1
                if sizes[row] <= LEAF_TOKENS:
                    ahead = sizes[row : row + 4096]
                    stop = np.flatnonzero((ahead > LEAF_TOKENS) | (np.cumsum(ahead) > STEP_TOKENS))
                    n = max(1, int(stop[0]) if len(stop) else len(ahead))
                part = batch.slice(row, n)
                lists = part.column(1)
                texts = _texts(codec, lists) if sizes[row] <= LEAF_TOKENS else pa.array([codec.decode(lists[0].values.to_numpy())], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, part.column(2), texts], ["doc_id", "token_ids", "n_tokens", "decoded"])
                row += n

    return run


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, token_ids, n_tokens), a row for each row of ``docs``. No shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(vocabulary, leaf), "doc_id long, token_ids array<int>, n_tokens long")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` (doc_id, token_ids, n_tokens) with ``decoded``, the text of the tokens. No shuffle."""
    rows = encoded.select("doc_id", "token_ids", "n_tokens")
    return rows.mapInArrow(_decoder(vocabulary), "doc_id long, token_ids array<int>, n_tokens long, decoded string")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS) -> DataFrame:
    """``decode(encode(docs))`` in one pass of one Python worker a task."""
    encode_, decode_ = _encoder(vocabulary, leaf), _decoder(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(arrays.tidy(lambda batches: decode_(encode_(batches))), "doc_id long, token_ids array<int>, n_tokens long, decoded string")
