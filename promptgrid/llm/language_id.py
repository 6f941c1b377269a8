"""Language identification by rank-order profiles of character n-grams.

Texts are lower-cased; every run of other than letters is one word border. The n-grams of 1 to 3 characters within a
word and its borders are ranked by count (ties: the n-gram with the smaller code points first) and the ``PROFILE``
most frequent make a profile. A language's profile comes from the labelled documents: the ``SAMPLE`` of each label with
the smallest hash of their id, which bounds training at any corpus size. A document's distance to a language is the
out-of-place measure, the sum over its profile of how far each n-gram's rank lies from its rank there, ``PROFILE`` for
an n-gram that is missing, divided by its largest possible value. The nearest language wins.

A document is accepted if that distance is at most ``MAX_DISTANCE``.

Defined cases. Null text, and texts without a letter: language ``und``, null distance, not accepted. Equal distances: the
label that sorts first. Null labels don't train. Without any labelled text every language is ``und``. Whole texts are
ranked, however long. Extra columns pass through ``keep_accepted``. Training reads ``doc_id``, ``text`` and the label
column; without that it fails with the analyzer's error for an unknown column, unless profiles are given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptgrid.llm import arrays

PROFILE = 300
SAMPLE = 400
MAX_DISTANCE = 0.65

_U64 = np.uint64
_SPACE = 32
#: (sorted n-gram codes, rank of each in each language, labels)
Profiles = tuple[np.ndarray, np.ndarray, list[str]]


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, in no order: its characters, first in the highest of three 21-bit fields."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = arrays.is_letter()[points]
    padded = np.full(len(points) + 2, _SPACE, np.uint32)
    padded[1:-1] = np.where(letter, points, _SPACE)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != _SPACE) | (padded[:-1] != _SPACE)
    c = padded[keep].astype(_U64)
    if len(c) < 3:
        return np.zeros(0, _U64)
    one, two = c << _U64(42), (c[:-1] << _U64(42)) | (c[1:] << _U64(21))
    three = two[:-1] | c[2:]
    return np.concatenate([one[c != _SPACE], two, three[c[1:-1] != _SPACE]])


def profile(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    codes = np.sort(codes)
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    counts = np.diff(np.append(edge, len(codes)))
    if len(edge) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        edge, counts = edge[counts >= least], counts[counts >= least]
    return codes[edge[np.argsort(-counts, kind="stable")][:size]]


def train(docs: DataFrame, sample: int = SAMPLE, label: str = "lang") -> Profiles:
    """Profiles from the labelled texts. The driver gets PROFILE n-grams a label; no other data leaves the executors."""
    named = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    chosen = named.select(F.col(label).cast("string").alias("label"), "doc_id").distinct().withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "label")
    # at most ``sample`` ids a label
    texts = named.select("doc_id", F.col(label).cast("string").alias("label"), "text").join(F.broadcast(chosen), ["doc_id", "label"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, n = np.unique(ngrams(text), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label_] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], ["label", "code", "n"])

    counted = texts.select("label", "text").mapInArrow(arrays.tidy(count), "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "code"))
    rows = counted.withColumn("rank", place - 1).where(F.col("rank") < PROFILE).select("label", "code", "rank").collect()
    labels = sorted({r["label"] for r in rows})
    codes = np.unique(np.array([r["code"] for r in rows], np.int64))
    ranks = np.full((len(codes), len(labels)), -1, np.int64)
    for r in rows:
        ranks[np.searchsorted(codes, r["code"]), labels.index(r["label"])] = r["rank"]
    return codes.view(_U64), ranks, labels


def distances(grams: np.ndarray, profiles: Profiles) -> np.ndarray:
    """Out-of-place distance of a document's profile to each language, as a share of the largest possible."""
    codes, ranks, _ = profiles
    at = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
    there = ranks[at]
    missing = (there < 0) | (codes[at] != grams)[:, None]
    apart = np.where(missing, PROFILE, np.abs(there - np.arange(len(grams))[:, None]))
    return apart.sum(axis=0) / (PROFILE * len(grams))


def _classifier(profiles: Profiles, limit: float, select: bool):
    def found(text: str | None) -> tuple[str, float | None]:
        grams = profile(ngrams(text)) if text and profiles[2] else ()
        if not len(grams):
            return "und", None
        away = distances(grams, profiles)
        best = int(away.argmin())
        return profiles[2][best], float(away[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            result = [found(t.as_py()) for t in batch.column("text")]
            accepted = pa.array([d is not None and d <= limit for _, d in result], pa.bool_())
            if select:
                yield batch.filter(accepted)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in result], pa.string()), pa.array([r[1] for r in result], pa.float64()), accepted], ["doc_id", "language", "distance", "accepted"])

    return run


def identify(docs: DataFrame, profiles: Profiles | None = None, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(doc_id, language, distance, accepted), a row for each row of ``docs``. No shuffle but training's."""
    profiles = train(docs) if profiles is None else profiles
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(arrays.tidy(_classifier(profiles, max_distance, False)), "doc_id long, language string, distance double, accepted boolean")


def keep_accepted(docs: DataFrame, profiles: Profiles | None = None, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` whose language is accepted."""
    profiles = train(docs) if profiles is None else profiles
    return docs.mapInArrow(arrays.tidy(_classifier(profiles, max_distance, True)), docs.schema)
