"""Rows to look at."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from promptgrid import schemas
from promptgrid.operators.chat import formatted

ROWS = {"classification": schemas.CLASSIFICATION_ROW, "raw": schemas.TEXT_ROW, "mcq": schemas.MCQ_ROW, "preference": schemas.PREFERENCE_ROW, "chat": schemas.CHAT_ROW}

VIEWS = {
    "classification": ("text", "label", "model_id", "metadata"),
    "raw": ("text", "text_source", "model_id", "language", "metadata"),
    "mcq": ("source_document", "question", "correct_answer", "incorrect_answer_1", "incorrect_answer_2", "incorrect_answer_3", "model_id", "metadata"),
    "preference": (
        "input_document", "question", "chosen_response", "rejected_response", "chosen_model_id", "rejected_model_id",
        "chosen_response_score", "rejected_response_score", "chosen_response_assessment", "rejected_response_assessment", "metadata",
    ),
    "chat": ("opening_question", "persona", "messages", "model_id", "metadata"),
}


def view(df: DataFrame, kind: str) -> DataFrame:
    """The columns shown for a kind of row; absent or null ones are empty. Other kinds show each row as JSON, with a
    warning."""
    if kind not in VIEWS:
        warnings.warn(f"no view for rows of kind {kind!r}, they are shown as JSON", UserWarning, stacklevel=2)
        return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
    types = dict(df.dtypes)

    def shown(c: str) -> Column:
        if c == "messages":
            return (formatted(F.col(c)) if c in types else F.lit("")).alias("conversation")
        if c == "metadata":
            return (F.coalesce(F.to_json(c), F.lit("{}")) if c in types else F.lit("{}")).alias(c)
        if c.endswith("_score"):
            return (F.coalesce(F.col(c), F.lit(0)) if c in types else F.lit(0)).alias(c)
        return (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in types else F.lit("")).alias(c)

    return df.select(*map(shown, VIEWS[kind]))


def page(df: DataFrame, ordinal: str, index: int, total: int) -> DataFrame:
    """The row at an ordinal from 0, held to [0, total - 1], with its label."""
    at = max(0, min(index, total - 1))
    return df.where(F.col(ordinal) == at).withColumn("label", F.lit(f"Example {at + 1} / {total}"))


def kind_of(row_type: str | StructType) -> str:
    """The kind of view for a row type, by the name of its class (``MCQRow`` and ``MCQDataset`` are ``mcq``) or by its fields."""
    if isinstance(row_type, StructType):
        return next((k for k, t in ROWS.items() if t == row_type), "generic")
    words = re.sub(r"(Row|Dataset|Config)$", "", row_type)
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", words).lower()
    return {"text": "raw", "ultrachat": "chat"}.get(name, name)
