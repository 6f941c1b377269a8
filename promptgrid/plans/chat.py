"""Multi-turn chat rows. The number of turns is drawn beforehand, so turn t is a stage over the conversations that have
one: at most ten stages of questions and answers, never a loop on the driver over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgrid import prompts, schemas
from promptgrid.config import ChatConfig
from promptgrid.functions import hashing
from promptgrid.functions.template import compile_template, fill
from promptgrid.operators import chat
from promptgrid.operators.grid import Prompts, cross, languages_frame, need_providers, providers_frame, values_frame
from promptgrid.operators.stage import answered, ask, explode_reply
from promptgrid.plans.common import lineage, metadata, typed
from promptgrid.providers.base import Provider

FIELDS = ["num_samples", "language_name", "domain", "topic", "subtopic"]


def compiled(config: ChatConfig) -> Prompts:
    return Prompts.of(config.question_generation_prompts or prompts.CHAT_QUESTIONS, FIELDS, config.expansion)


def grid(spark: SparkSession, config: ChatConfig, providers: list[Provider]) -> DataFrame:
    need_providers(providers)
    variants = compiled(config)
    topics = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(config.topics_and_subtopics.items())], "topic_at int, topic string, subtopics array<string>")
    pairs = topics.select("topic_at", "topic", F.posexplode("subtopics").alias("subtopic_at", "subtopic"))
    rows = cross(pairs, languages_frame(spark, config.spoken), variants.frame(spark, config.seed), providers_frame(spark, providers))
    values = {"num_samples": F.lit(config.num_samples), "domain": F.lit(config.domain)} | {c: F.col(c) for c in ("language_name", "topic", "subtopic")}
    return rows.withColumn("prompt", variants.column(values))


def _message(role: str, content):
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def with_personas(rows: DataFrame, config: ChatConfig, key: list) -> DataFrame:
    """``rows`` with a ``persona`` each, by a seeded draw."""
    if not isinstance(config.personas, DataFrame):
        return rows.withColumn("persona", chat.persona(config.personas, config.seed, *key))
    people = values_frame(rows.sparkSession, config.personas.where(F.col(f"`{config.personas.columns[0]}`").isNotNull()), "persona_at", "persona")
    n = people.count()
    if not n:
        raise ValueError("chats need personas")
    at = F.floor(hashing.uniform(config.seed, "persona", *key) * n).cast("long")
    return rows.withColumn("persona_at", at).join(people, "persona_at").drop("persona_at")


def chat_rows(spark: SparkSession, config: ChatConfig, providers: list[Provider]) -> DataFrame:
    if not isinstance(config.personas, DataFrame) and not config.personas:
        raise ValueError("chats need personas")
    asked = answered(ask(grid(spark, config, providers), "prompt", providers, schemas.USER_QUESTIONS, without=("prompt",), name="questions"))
    rows = explode_reply(asked, "reply.questions", "item", "question").drop("reply")
    key = [F.col(c) for c in ("topic", "subtopic", "language", "expansion", "provider", "item")]
    rows = with_personas(rows, config, key).withColumns({"turns": chat.turn_count(config.max_turns, config.conversation_continuation_prob, config.seed, *key), "domain": F.lit(config.domain)})

    def filled(template: str, *fields: str, **given):
        values = {f: F.col(f) for f in fields} | given
        return fill(compile_template(template, values), values)

    first = filled(config.persona_question_reformulation_prompt or prompts.CHAT_REFORMULATE, "question", "persona", "topic", "subtopic")
    rows = answered(ask(rows.withColumn("prompt", first), "prompt", providers, schemas.QUESTION, without=("prompt",), name="openings"))
    rows = rows.withColumn("asked", F.col("reply.question")).drop("reply")
    answer = filled(config.simulated_assistant_prompt or prompts.CHAT_ANSWER, "domain", "topic", "subtopic", question=F.col("asked"))
    rows = answered(ask(rows.withColumn("prompt", answer), "prompt", providers, schemas.ANSWER, without=("prompt",), name="answers 1"))
    rows = rows.withColumn("messages", F.array(_message("user", F.col("asked")), _message("assistant", F.col("reply.answer")))).drop("reply", "asked")
    done = rows.where("turns <= 1")
    going = rows.where("turns > 1")
    for turn in range(2, config.max_turns + 1):
        follow = filled(config.user_followup_prompt or prompts.CHAT_FOLLOW_UP, "persona", "subtopic", "domain", dialog_summary=chat.dialog_summary(F.col("messages")))
        going = answered(ask(going.withColumn("prompt", follow), "prompt", providers, schemas.QUESTION, without=("prompt",), name=f"questions {turn}"))
        going = going.withColumn("messages", F.concat("messages", F.array(_message("user", F.col("reply.question"))))).drop("reply")
        going = answered(ask(going, "messages", providers, schemas.ANSWER, name=f"answers {turn}"))
        going = going.withColumn("messages", F.concat("messages", F.array(_message("assistant", F.col("reply.answer"))))).drop("reply")
        done = done.unionByName(going.where(F.col("turns") <= turn).select(*done.columns))
        going = going.where(F.col("turns") > turn)
    about = metadata(domain=F.col("domain"), topic=F.col("topic"), subtopic=F.col("subtopic"))
    return typed(done, schemas.CHAT_ROW, opening_question=chat.opening(F.col("messages")), uuid=lineage(config.seed, "chat", *key), metadata=about)
