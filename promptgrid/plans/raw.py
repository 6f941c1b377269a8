"""Raw text rows: document types x topics x languages x prompt variants x providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgrid import prompts, schemas
from promptgrid.config import RawConfig
from promptgrid.operators.grid import Prompts, cross, cross_values, languages_frame, need_providers, providers_frame, values_frame
from promptgrid.operators.stage import answered, ask, explode_reply
from promptgrid.plans.common import lineage, metadata, typed
from promptgrid.providers.base import Provider

FIELDS = ["num_samples", "language_name", "document_type", "topic"]


def compiled(config: RawConfig) -> Prompts:
    return Prompts.of(config.prompts or prompts.RAW, FIELDS, config.expansion)


def grid(spark: SparkSession, config: RawConfig, providers: list[Provider]) -> DataFrame:
    need_providers(providers)
    variants = compiled(config)
    kinds = values_frame(spark, config.document_types, "type_at", "document_type")
    topics = values_frame(spark, config.topics, "topic_at", "topic")
    rows = cross(cross_values(kinds, topics, config.topics), languages_frame(spark, config.spoken), variants.frame(spark, config.seed), providers_frame(spark, providers))
    values = {"num_samples": F.lit(config.num_samples_per_prompt)} | {c: F.col(c) for c in FIELDS[1:]}
    return rows.withColumn("prompt", variants.column(values))


def raw_rows(spark: SparkSession, config: RawConfig, providers: list[Provider]) -> DataFrame:
    asked = answered(ask(grid(spark, config, providers), "prompt", providers, schemas.TEXT_EXAMPLES, without=("prompt",), name="texts"))
    rows = explode_reply(asked, "reply.list_of_text_examples")
    key = ("raw", F.col("document_type"), F.col("topic"), F.col("language"), F.col("expansion"), F.col("provider"), F.col("item"))
    about = metadata(document_type=F.col("document_type"), topic=F.col("topic"))
    return typed(rows, schemas.TEXT_ROW, text=F.col("entry.text"), text_source=F.lit("synthetic"), uuid=lineage(config.seed, *key), metadata=about)
