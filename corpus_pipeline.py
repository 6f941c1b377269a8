"""The corpus pipeline: language, exact and near duplicates, source mix, tokens.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from promptgrid import storage
from promptgrid.llm import bpe, exact_dedup, language_id, mixing, near_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the table's own labels; others go."""
    return language_id.keep_accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as its source's budget asks for, and the last one of a
    source ends where the budget does."""
    return mixing.cut(mixing.mix(docs), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    return bpe.round_trip(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("tokenize", tokenize)]

#: MinHash and BPE can't be put in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's own tables go when it is written, its result when the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{storage.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with storage.scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            storage.delete_path(spark, before)
        before = f"{place}/{name}"
    return docs
