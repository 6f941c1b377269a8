"""Token counts of documents of any length, by overlap resynchronisation.

A text longer than ``CHUNK_CHARS`` is encoded in chunks that overlap by ``OVERLAP_CHARS``, with the byte offset of every
token. Two neighbouring chunks are spliced at a place in their overlap that (a) is stable in the sense of bpe.py, such as
after a letter before another kind of character, and (b) is a token border in both encodings by their offsets. From such a place on the
right chunk's tokens are those of the whole text, up to it the left one's are. If the overlap has no such place, the
left chunk is widened, its overlap doubling each time, to the text's end if need be. So the count is that of the text
encoded in one piece, and no step holds more tokens than a widened chunk has.

Defined cases. Null text: null count. Empty text: 0. A string id that is no number fails the job in ANSI mode. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptgrid.llm import bpe

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256


def count(codec: bpe.Codec, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int, int]:
    """(tokens, chunks encoded, times that an overlap was widened) of one text."""
    total, start, chunks, widened = 0, 0, 0, 0
    while True:
        border, wide = start + chunk, overlap
        while True:
            end = min(len(text), border + wide)
            tokens = codec.plain.encode_ordinary(text[start:end])
            chunks += 1
            if end == len(text):
                return total + len(tokens), chunks, widened
            ends = np.cumsum(codec.widths[tokens])
            place = _splice(codec, text, start, border, end, ends)
            if place:
                break
            wide, widened = wide * 2, widened + 1
        at, used = place
        total += used
        start = at


def _splice(codec: bpe.Codec, text: str, start: int, border: int, end: int, ends: np.ndarray) -> tuple[int, int] | None:
    """(place, tokens of the left chunk before it): the first stable place at which both encodings have a token border.

    The right chunk is first encoded from the border, wherever that cuts, over the overlap alone: the comparison of
    offsets is what shows that the two have come together.
    """
    right = np.cumsum(codec.widths[codec.plain.encode_ordinary(text[border:end])])
    before = len(text[start:border].encode())
    for place in codec.stable.finditer(text, border, end):
        if place.end() >= end:
            continue
        offset = len(text[border : place.end()].encode())
        k = int(np.searchsorted(right, offset))
        j = int(np.searchsorted(ends, before + offset))
        if k < len(right) and right[k] == offset and j < len(ends) and ends[j] == before + offset:
            return place.end(), j + 1
    return None


def _counter(vocabulary: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.Codec.of(vocabulary)
        for batch in batches:
            found = [count(codec, t.as_py(), chunk, overlap) if t.is_valid else (None, None, None) for t in batch.column(1)]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "n_chunks", "n_widened"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = bpe.VOCABULARY, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_tokens, n_chunks, n_widened), a row for each row of ``docs``. No shuffle."""
    if chunk < 1 or overlap < 1:
        raise ValueError("chunk and overlap must be positive")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(vocabulary, chunk, overlap), "doc_id long, n_tokens long, n_chunks long, n_widened long")
