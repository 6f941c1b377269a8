"""Queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgrid.llm import bpe, exact_dedup, fingerprints, language_id, mixing, near_dedup, secret_scan, sharding, substring_dedup, token_counts


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_docs(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_docs(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_docs(spark, sf_dir))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir), carry=["doc_id", "source"])


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two rounds: the lower half of the ids is the history, whose own repeats go, then the rest is looked up in it."""
    docs = _docs(spark, sf_dir)
    ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = F.lit(0 if ends[0] is None else (ends[0] + ends[1]) // 2).cast("long")
    later = F.coalesce(F.col("doc_id") > middle, F.lit(True))
    history = docs.where(~later)
    index = exact_dedup.build_index(history)
    return exact_dedup.duplicates(history, index=index).unionByName(exact_dedup.duplicates(docs.where(later), history, index))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_docs(spark, sf_dir)).withColumn("distance", F.round("distance", 9))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.similar(_docs(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans: of one source, when a rule was at an older version, and of the whole table with the ledger of the first."""
    docs = _docs(spark, sf_dir)
    source = docs.agg(F.max("source")).first()[0]
    _, ledger, findings = secret_scan.scan(docs.where(F.col("source") == source), rules=secret_scan.RULES | {"assigned_token": secret_scan.ASSIGNED_TOKEN_1})
    return secret_scan.scan(docs, ledger, findings)[0]


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_documents(_docs(spark, sf_dir)).withColumn("first_doc_ids", F.array_join(F.col("first_doc_ids").cast("array<string>"), ","))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_minhash_near_dedup, op3_token_counts, op4_sharding, op5_source_mixing, op6_exact_dedup, op7_language_id, op8_document_fingerprints, op9_secret_scan, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_sharding": sharding.sql(),
        "op5_source_mixing": mixing.sql(),
        "op6_exact_dedup": "SELECT doc_id, winner_doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS winner_doc_id FROM documents WHERE text IS NOT NULL) WHERE doc_id <> winner_doc_id",
        "op9_secret_scan": secret_scan.sql(),
        "op10_substring_dedup": substring_dedup.sql(),
    }
