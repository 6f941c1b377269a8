"""Preference rows: questions on documents, two answers to each, judged and put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgrid import prompts, schemas
from promptgrid.config import PreferenceConfig
from promptgrid.functions import hashing
from promptgrid.functions.template import compile_template, fill
from promptgrid.operators.grid import cross, languages_frame
from promptgrid.operators.preference import swap_by_score
from promptgrid.operators.stage import Call, answered, ask, ask_all, explode_reply
from promptgrid.plans.common import lineage, metadata, numbered_texts, typed
from promptgrid.providers.base import Provider


def documents(spark: SparkSession, config: PreferenceConfig, key: str | None = None) -> DataFrame:
    """(document_key, document)."""
    if isinstance(config.input_documents, DataFrame):
        docs = config.input_documents.where(F.col(config.document_column).isNotNull())
        return docs.select((F.col(key) if key else F.xxhash64(config.document_column)).cast("string").alias("document_key"), F.col(config.document_column).alias("document"))
    if not config.input_documents:
        raise ValueError("input_documents must not be empty")
    return spark.createDataFrame([(str(i), d) for i, d in enumerate(config.input_documents)], "document_key string, document string")


def questions_grid(spark: SparkSession, config: PreferenceConfig, key: str | None = None, docs: DataFrame | None = None) -> DataFrame:
    """A row for each document and language, with the prompt of one template, drawn by seed. ``docs``: the documents, if
    they are at hand."""
    docs = documents(spark, config, key) if docs is None else docs
    templates = config.question_generation_prompts or prompts.PREFERENCE_QUESTIONS
    fields = {"document": F.col("document"), "num_samples": F.lit(config.num_samples_per_prompt), "language_name": F.col("language_name")}
    rows = cross(docs, languages_frame(spark, config.spoken))
    drawn = F.floor(hashing.uniform(config.seed, "template", F.col("language"), F.col("document_key")) * len(templates)).cast("int")
    filled = [fill(compile_template(t, fields), fields) for t in templates]
    prompt = F.when(F.col("template") == 0, filled[0])
    for i, f in enumerate(filled[1:], 1):
        prompt = prompt.when(F.col("template") == i, f)
    return rows.withColumn("template", drawn).withColumn("prompt", prompt)


def _filled(template: str, *fields: str, **given):
    values = {f: F.col(f) for f in fields} | given
    return fill(compile_template(template, values), values)


def preference_rows(
    spark: SparkSession, config: PreferenceConfig, question_provider: Provider, chosen_provider: Provider, rejected_provider: Provider, judge: Provider | None = None, key: str | None = None
) -> DataFrame:
    if config.evol_instruct:
        raise NotImplementedError("evolving instructions is not supported")
    docs = numbered_texts(documents(spark, config, key), "documents")
    texts = docs.select("row_id", "document")
    asked = ask(questions_grid(spark, config, key, docs), "prompt", [question_provider], schemas.USER_QUESTIONS, provider=None, without=("prompt", "document", "template"), name="questions")
    rows = explode_reply(answered(asked), "reply.questions", "item", "question").drop("reply")
    # both answers to a question in one pass, and both judgements; the text is joined to its rows for each
    with_text = rows.join(texts, "row_id").withColumns(
        {
            "chosen_prompt": _filled(config.chosen_response_generation_prompt or prompts.PREFERENCE_CHOSEN, "document", "question", "language_name"),
            "rejected_prompt": _filled(config.rejected_response_generation_prompt or prompts.PREFERENCE_REJECTED, "document", "question", "language_name"),
        }
    )
    calls = [Call(f"{s}_prompt", [p], schemas.ANSWER, f"{s}_reply", status=f"{s}_status", error=f"{s}_error") for s, p in (("chosen", chosen_provider), ("rejected", rejected_provider))]
    rows = ask_all(with_text, calls, without=("document", "chosen_prompt", "rejected_prompt"), name="answers").where("chosen_status = 'ok' and rejected_status = 'ok'")
    rows = rows.withColumns({"chosen_response": F.col("chosen_reply.answer"), "rejected_response": F.col("rejected_reply.answer"), "chosen_model_id": F.lit(chosen_provider.model_id), "rejected_model_id": F.lit(rejected_provider.model_id)})
    rows = rows.drop(*(f"{s}_{c}" for s in ("chosen", "rejected") for c in ("reply", "status", "error")))
    if config.llm_as_judge and judge is not None:
        template = config.judge_prompt or prompts.PREFERENCE_JUDGE
        judged = rows.join(texts, "row_id").withColumns({f"{s}_prompt": _filled(template, "document", "question", response=F.col(f"{s}_response")) for s in ("chosen", "rejected")})
        calls = [Call(f"{s}_prompt", [judge], schemas.JUDGEMENT, f"{s}_reply", status=f"{s}_status", error=f"{s}_error") for s in ("chosen", "rejected")]
        judged = ask_all(judged, calls, without=("document", "chosen_prompt", "rejected_prompt"), name="judgements")
        # without the first judgement the second doesn't count, and the pair stays as it is
        first = F.col("chosen_status") == "ok"
        scores = {"chosen_response_score": F.col("chosen_reply.score"), "chosen_response_assessment": F.col("chosen_reply.assessment")}
        scores |= {f"rejected_response_{c}": F.when(first, F.col(f"rejected_reply.{c}")) for c in ("score", "assessment")}
        judged = judged.withColumns(scores)
        outside = [~F.coalesce(F.col(f"{s}_response_score").between(1, 10), F.lit(True)) for s in ("chosen", "rejected")]
        rows = swap_by_score(judged.withColumn("score_in_range", ~(outside[0] | outside[1])))
    uuid = lineage(config.seed, "preference", F.col("document_key"), F.col("language"), F.col("item"))
    about = metadata(instruction_model=question_provider.model_id)
    if "score_in_range" in rows.columns:
        about = F.when(F.col("score_in_range"), about).otherwise(F.map_concat(about, metadata(score_in_range="false")))
    rows = rows.join(texts, "row_id")
    return typed(rows, schemas.PREFERENCE_ROW, input_document=F.col("document"), preference_source=F.lit("synthetic"), uuid=uuid, metadata=about)
