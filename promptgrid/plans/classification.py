"""Text classification rows: classes x languages x prompt variants x providers, a row for each text of a reply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgrid import prompts, schemas
from promptgrid.config import ClassificationConfig
from promptgrid.operators.grid import Prompts, cross, languages_frame, need_providers, providers_frame
from promptgrid.operators.order import numbered
from promptgrid.operators.stage import answered, ask, explode_reply
from promptgrid.plans.common import lineage, metadata, typed
from promptgrid.providers.base import Provider

FIELDS = ["num_samples", "labels_listing", "label_name", "label_description", "language_name"]


def compiled(config: ClassificationConfig) -> Prompts:
    return Prompts.of(config.prompts or prompts.CLASSIFICATION, FIELDS, config.expansion)


def grid(spark: SparkSession, config: ClassificationConfig, providers: list[Provider]) -> DataFrame:
    """A row for each call, with its prompt."""
    need_providers(providers)
    variants = compiled(config)
    if isinstance(config.classes, DataFrame):
        # every prompt lists all classes, so they are as few as a prompt can hold
        classes = numbered(config.classes.select(F.col("name").alias("label_name"), F.col("description").alias("label_description")), "class_at", "label_name")
        names = [r[0] for r in classes.orderBy("class_at").select("label_name").collect()]
    else:
        names = [c["name"] for c in config.classes]
        classes = spark.createDataFrame([(i, c["name"], c["description"]) for i, c in enumerate(config.classes)], "class_at int, label_name string, label_description string")
    if not names:
        raise ValueError("at least one class is needed")
    rows = cross(classes, languages_frame(spark, config.spoken), variants.frame(spark, config.seed), providers_frame(spark, providers))
    listing = str(names)
    values = {"num_samples": F.lit(config.num_samples_per_prompt), "labels_listing": F.lit(listing)} | {c: F.col(c) for c in FIELDS[2:]}
    return rows.withColumn("prompt", variants.column(values))


def classification_rows(spark: SparkSession, config: ClassificationConfig, providers: list[Provider]) -> DataFrame:
    asked = answered(ask(grid(spark, config, providers), "prompt", providers, schemas.TEXT_ENTRIES, without=("prompt",), name="texts"))
    rows = explode_reply(asked, "reply.entries")
    key = ("classification", F.col("label_name"), F.col("language"), F.col("expansion"), F.col("provider"), F.col("item"))
    return typed(rows, schemas.CLASSIFICATION_ROW, text=F.col("entry"), label=F.col("label_name"), label_source=F.lit("synthetic"), uuid=lineage(config.seed, *key), metadata=metadata())
