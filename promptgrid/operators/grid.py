"""The cross product of rows, languages, prompt variants and providers."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgrid.config import Expansion
from promptgrid.functions.template import Part, compile_template, fill, residual
from promptgrid.operators.expand import expansion_frame
from promptgrid.operators.order import numbered
from promptgrid.providers.base import Provider


@dataclass(frozen=True)
class Prompts:
    """Templates compiled for one list of mandatory fields."""

    parts: list[list[Part]]
    residuals: list[str]
    expansion: Expansion

    @staticmethod
    def of(templates: list[str] | tuple[str, ...], fields: list[str], expansion: Expansion) -> Prompts:
        optional = expansion.placeholders
        parts = [compile_template(t, fields, optional, always=not expansion.combinatorial) for t in templates]
        return Prompts(parts, [residual(t, fields) for t in templates], expansion)

    def frame(self, spark: SparkSession, seed: int) -> DataFrame:
        return expansion_frame(spark, self.residuals, self.expansion, seed)

    def column(self, values: Mapping[str, Column]) -> Column:
        """The prompt of a row of the grid; chosen placeholder values come from its map ``values``."""
        chosen = {k: F.try_element_at("values", F.lit(k)) for k in self.expansion.placeholders}
        filled = [fill(p, chosen | dict(values)) for p in self.parts]
        if len(filled) == 1:
            return filled[0]
        out = F.when(F.col("template") == 0, filled[0])
        for i, f in enumerate(filled[1:], 1):
            out = out.when(F.col("template") == i, f)
        return out


def languages_frame(spark: SparkSession, languages: Mapping[str, str]) -> DataFrame:
    rows = [(i, code, name) for i, (code, name) in enumerate(languages.items())]
    return spark.createDataFrame(rows, "language_at int, language string, language_name string")


def providers_frame(spark: SparkSession, providers: list[Provider]) -> DataFrame:
    return spark.createDataFrame([(i, p.model_id) for i, p in enumerate(providers)], "provider int, model_id string")


def values_frame(spark: SparkSession, values: list[str] | DataFrame, at: str, name: str) -> DataFrame:
    """(ordinal, text) of a list, or of the first column of a frame."""
    if isinstance(values, DataFrame):
        return numbered(values.select(F.col(f"`{values.columns[0]}`").cast("string").alias(name)), at, name)
    return spark.createDataFrame(list(enumerate(values)), f"{at} int, {name} string")


def cross(rows: DataFrame, *small: DataFrame) -> DataFrame:
    """``rows`` streamed past configuration tables. Their sizes are what a user typed, and ``max_samples`` bounds the
    expansion; nothing that grows with the data is broadcast."""
    for s in small:
        rows = rows.crossJoin(F.broadcast(s))
    return rows


def cross_values(rows: DataFrame, values: DataFrame, given: list[str] | DataFrame) -> DataFrame:
    """``rows`` with every one of ``values``: these are broadcast if they are a list that a user typed; those of a frame
    may be any number, and how they are joined is left to the optimizer."""
    return rows.crossJoin(values) if isinstance(given, DataFrame) else cross(rows, values)


def need_providers(providers: list[Provider]) -> None:
    if not providers:
        raise ValueError("at least one provider is needed")
