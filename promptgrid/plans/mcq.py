"""Multiple choice rows: two stages, questions from documents and wrong answers for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgrid import prompts, schemas
from promptgrid.config import MCQConfig
from promptgrid.functions.template import compile_template, fill
from promptgrid.functions.text import strip
from promptgrid.operators.filters import has_context, length_between
from promptgrid.operators.grid import Prompts, cross, languages_frame, need_providers, providers_frame
from promptgrid.operators.stage import answered, ask, explode_reply
from promptgrid.plans.common import lineage, metadata, numbered_texts, typed
from promptgrid.providers.base import Provider
from promptgrid.sources.readers import load_source, source_name

FIELDS = ["num_samples", "language_name", "document", "context"]
DISTRACTORS = 3


def compiled(config: MCQConfig) -> tuple[Prompts, Prompts]:
    """Prompts for documents without and with a context."""
    return (
        Prompts.of(config.prompts or prompts.MCQ, FIELDS, config.expansion),
        Prompts.of(config.prompts or prompts.MCQ_CONTEXT, FIELDS, config.expansion),
    )


def documents(spark: SparkSession, config: MCQConfig, key: str | None = None) -> DataFrame:
    """(source_key, document, context) of the source rows whose text has the right length."""
    rows = load_source(spark, config.source, config.sample_count, config.text_column or "text", key)
    docs = length_between(rows, config.text_column, config.min_document_length, config.max_document_length)
    if config.text_column not in docs.columns:
        return spark.createDataFrame([], "source_key long, document string, context string")
    context = F.when(has_context(docs, config.context_column), F.col(config.context_column)) if config.context_column in docs.columns else F.lit(None).cast("string")
    row = F.col(key) if key else F.xxhash64(config.text_column)
    return docs.select(row.alias("source_key"), F.col(config.text_column).alias("document"), context.alias("context"))


def grid(spark: SparkSession, config: MCQConfig, providers: list[Provider], key: str | None = None, docs: DataFrame | None = None) -> DataFrame:
    """A row for each call. ``docs``: the documents, if they are at hand."""
    need_providers(providers)
    docs = documents(spark, config, key) if docs is None else docs
    plain, contextual = compiled(config)
    values = {"num_samples": F.lit(config.num_samples_per_prompt)} | {c: F.col(c) for c in FIELDS[1:]}
    by = (languages_frame(spark, config.spoken), providers_frame(spark, providers))
    if config.prompts is None:
        # one default template of either kind, without placeholders
        grid_ = cross(docs, *by, plain.frame(spark, config.seed))
        return grid_.withColumn("prompt", F.when(F.col("context").isNull(), plain.column(values)).otherwise(contextual.column(values)))
    return cross(docs, *by, plain.frame(spark, config.seed)).withColumn("prompt", plain.column(values))


def mcq_rows(spark: SparkSession, config: MCQConfig, providers: list[Provider], key: str | None = None) -> DataFrame:
    docs = numbered_texts(documents(spark, config, key), "documents")
    asked = answered(ask(grid(spark, config, providers, key, docs), "prompt", providers, schemas.QA_ENTRIES, without=("prompt", "document", "context"), name="questions"))
    questions = explode_reply(asked, "reply.entries").drop("reply")
    questions = questions.select("*", "entry.question", F.col("entry.answer").alias("correct_answer")).drop("entry")
    parts = compile_template(config.distractor_prompt or prompts.MCQ_DISTRACTORS, ["question", "correct_answer", "language_name"])
    filled = fill(parts, {c: F.col(c) for c in ("question", "correct_answer", "language_name")})
    wrong = answered(ask(questions.withColumn("prompt", filled), "prompt", providers, schemas.TEXT_ENTRIES, without=("prompt",), name="wrong answers"))
    enough = wrong.where(F.size("reply.entries") >= DISTRACTORS).join(docs.select("row_id", "document"), "row_id")
    picked = {f"incorrect_answer_{i + 1}": strip(F.col("reply.entries")[i]) for i in range(DISTRACTORS)}
    key_ = ("mcq", F.col("source_key"), F.col("language"), F.col("expansion"), F.col("provider"), F.col("item"))
    return typed(
        enough, schemas.MCQ_ROW, source_document=F.col("document"), mcq_source=F.lit("synthetic"), uuid=lineage(config.seed, *key_), metadata=metadata(source_dataset=source_name(config.source)), **picked
    )
