"""Prompt expansion and closed-form counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import product
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptgrid.config import ChatConfig, ClassificationConfig, Expansion, GenericConfig, MCQConfig, PreferenceConfig, RawConfig
from promptgrid.functions import hashing
from promptgrid.functions.template import compile_template, fill_text, used_keys


def check_expansion(templates: list[str], e: Expansion) -> None:
    """The guard against combinatorial explosion, before anything runs."""
    if e.combinatorial:
        total = sum(prod(len(e.placeholders[k]) for k in used_keys(t, e.placeholders)) or 1 for t in templates)
        if total > e.max_samples:
            raise ValueError(f"{total} combinations exceed max_samples ({e.max_samples}); draw samples with combinatorial=False")
    elif e.num_random_samples > e.max_samples:
        raise ValueError(f"num_random_samples ({e.num_random_samples}) exceeds max_samples ({e.max_samples})")


def _draw(values: list[str], *parts: object) -> str:
    import hashlib

    u = int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32
    return values[int(u * len(values))]


def choices(templates: list[str], e: Expansion, seed: int = 42) -> Iterator[tuple[int, dict[str, str]]]:
    """(template's index, chosen values) of each expansion, in order: the last key varies fastest."""
    check_expansion(templates, e)
    if e.combinatorial:
        for i, template in enumerate(templates):
            keys = used_keys(template, e.placeholders)
            for values in product(*(e.placeholders[k] for k in keys)):
                yield i, dict(zip(keys, values, strict=True))
    else:
        for n in range(e.num_random_samples):
            i = n % len(templates)
            yield i, {k: _draw(e.placeholders[k], seed, n, k) for k in used_keys(templates[i], e.placeholders)}


def expand_prompts(
    templates: list[str], placeholders: Mapping[str, list[str]], combinatorial: bool = True, num_random_samples: int = 1, max_samples: int = 1000, seed: int = 42
) -> list[tuple[str, dict[str, str]]]:
    """(prompt, chosen values) pairs. A template without placeholders passes as it is in combinatorial mode."""
    e = Expansion(placeholders, combinatorial, num_random_samples, max_samples)
    out = []
    for i, chosen in choices(templates, e, seed):
        out.append((fill_text(compile_template(templates[i], chosen), chosen) if chosen or not combinatorial else templates[i], chosen))
    return out


def expansion_frame(spark: SparkSession, templates: list[str], e: Expansion, seed: int = 42) -> DataFrame:
    """(expansion, template, values): ordinal, template's index and chosen values of each expansion.

    Combinations are a chain of exploded arrays, so they are made by the executors.
    """
    check_expansion(templates, e)
    if not e.combinatorial:
        numbers = spark.range(e.num_random_samples).select(F.col("id").alias("expansion"), (F.col("id") % len(templates)).cast("int").alias("template"))
        entries = [
            F.when(F.col("template").isin([i for i, t in enumerate(templates) if k in used_keys(t, e.placeholders)] or [-1]), F.struct(F.lit(k).alias("key"), hashing.pick(F.array(*map(F.lit, v)), seed, F.col("expansion"), k).alias("value")))
            for k, v in e.placeholders.items()
            if v
        ]
        values = F.map_from_entries(F.filter(F.array(*entries), lambda x: x.isNotNull())) if entries else F.create_map().cast("map<string,string>")
        return numbers.select("expansion", "template", values.alias("values"))
    frames, base = None, 0
    for i, template in enumerate(templates):
        keys = used_keys(template, e.placeholders)
        one = spark.range(1).select(F.lit(base).cast("long").alias("expansion"), F.lit(i).alias("template"), F.create_map().cast("map<string,string>").alias("values"))
        for k in keys:
            n = len(e.placeholders[k])
            one = one.select("expansion", "template", "values", F.posexplode(F.array(*map(F.lit, e.placeholders[k])).cast("array<string>")).alias("at", "value"))
            one = one.select(((F.col("expansion") - base) * n + F.col("at") + base).alias("expansion"), "template", F.map_concat("values", F.create_map(F.lit(k), F.col("value"))).alias("values"))
        base += prod(len(e.placeholders[k]) for k in keys)
        frames = one if frames is None else frames.unionByName(one)
    return frames


def num_expansions(templates: list[str] | None, e: Expansion) -> int:
    """Expansions as the estimate counts them: 1 without templates of one's own, an empty list of values as 1."""
    if templates is None:
        return 1
    if not e.combinatorial:
        return min(e.num_random_samples, e.max_samples)
    return sum(prod(max(len(e.placeholders[k]), 1) for k in used_keys(t, e.placeholders)) for t in templates)


def _size(values) -> int:
    return values.count() if isinstance(values, DataFrame) else len(values)


def planned_rows(grid: DataFrame, samples: int) -> int:
    """The rows that a pipeline's grid asks for, counted after its filters and before any model is asked: ``samples`` a
    prompt."""
    return grid.count() * samples


def expected_rows(config: object, providers: int, source_rows: int | None = None) -> int:
    """The closed-form estimate of a pipeline's rows. ``source_rows``: rows of the source, for those that read one."""
    if isinstance(config, ClassificationConfig):
        factors = [len(config.spoken), config.num_samples_per_prompt, _size(config.classes), num_expansions(config.prompts, config.expansion)]
    elif isinstance(config, RawConfig):
        factors = [len(config.spoken), config.num_samples_per_prompt, _size(config.document_types), _size(config.topics), num_expansions(config.prompts, config.expansion)]
    elif isinstance(config, ChatConfig):
        factors = [len(config.spoken), config.num_samples, sum(map(len, config.topics_and_subtopics.values())), num_expansions(config.question_generation_prompts, config.expansion)]
    elif isinstance(config, MCQConfig):
        rows = source_rows if config.sample_count is None else min(source_rows, config.sample_count)
        factors = [len(config.spoken), config.num_samples_per_prompt, rows, num_expansions(config.prompts, config.expansion)]
    elif isinstance(config, PreferenceConfig):
        rows = _size(config.input_documents) if source_rows is None else source_rows
        factors = [rows, len(config.spoken), config.num_samples_per_prompt, 1 if config.question_generation_prompts is None else len(config.question_generation_prompts)]
    elif isinstance(config, GenericConfig):
        rows = source_rows if config.sample_count is None else min(source_rows, config.sample_count)
        factors = [len(config.spoken), config.num_samples_per_prompt, rows, num_expansions(config.prompts, config.expansion)]
    else:
        raise TypeError(type(config).__name__)
    if not providers and not isinstance(config, ClassificationConfig):
        raise ValueError("at least one provider is needed")
    return providers * prod(factors)
