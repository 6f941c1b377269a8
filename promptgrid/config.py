"""Pipeline configurations, checked when they are made."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

#: A source row's fate: True passes it over. A Column or SQL text runs in the JVM; a callable gets the row as a dict.
Skip = Column | str | Callable[[dict[str, Any]], bool]
ENGLISH: Mapping[str, str] = {"en": "English"}


@dataclass(frozen=True)
class Expansion:
    """Values for ``{{placeholder}}`` fields: every combination, or ``num_random_samples`` seeded draws."""

    placeholders: Mapping[str, list[str]] = field(default_factory=dict)
    combinatorial: bool = True
    num_random_samples: int = 1
    max_samples: int = 1000


def require_placeholders(name: str, prompts: str | list[str] | None, required: list[str]) -> None:
    """Every prompt has every required ``{field}``."""
    for i, prompt in enumerate([prompts] if isinstance(prompts, str) else prompts or []):
        missing = [f"{{{p}}}" for p in required if f"{{{p}}}" not in prompt]
        if missing:
            raise ValueError(f"{name}[{i}] lacks {', '.join(missing)}; it needs {', '.join(f'{{{p}}}' for p in required)}")


def require_optional(name: str, prompts: list[str] | None, expansion: Expansion) -> None:
    """Every ``{{field}}`` has a non-empty list of values."""
    for i, prompt in enumerate(prompts or []):
        for key in re.findall(r"\{\{(\w+)\}\}", prompt):
            values = expansion.placeholders.get(key)
            if values is None:
                raise ValueError(f"{name}[{i}]: no values for {{{{{key}}}}} in the expansion")
            if not values or not isinstance(values, (list, tuple)):
                raise ValueError(f"{name}[{i}]: the values for {{{{{key}}}}} must be a list that isn't empty")


def _require_list(name: str, values: Any) -> None:
    if not isinstance(values, DataFrame) and not values:
        raise ValueError(f"{name} must not be empty")


@dataclass(frozen=True)
class _Base:
    prompts: list[str] | None = None
    num_samples_per_prompt: int = 5
    output_file: str = "rows.jsonl"
    expansion: Expansion = field(default_factory=Expansion)
    languages: Mapping[str, str] = field(default_factory=lambda: ENGLISH)
    seed: int = 42

    @property
    def spoken(self) -> Mapping[str, str]:
        return self.languages or ENGLISH


@dataclass(frozen=True)
class ClassificationConfig(_Base):
    """``classes``: {"name", "description"} each, or a frame with these columns."""

    classes: list[Mapping[str, str]] | DataFrame = field(default_factory=list)
    output_file: str = "classification.jsonl"

    def __post_init__(self) -> None:
        require_placeholders("prompts", self.prompts, ["num_samples", "language_name", "label_name", "label_description"])
        require_optional("prompts", self.prompts, self.expansion)
        for c in [self.classes.columns] if isinstance(self.classes, DataFrame) else self.classes:
            if not {"name", "description"} <= set(c):
                raise ValueError("a class needs a name and a description")


@dataclass(frozen=True)
class RawConfig(_Base):
    """``document_types`` and ``topics``: texts, or a frame whose first column has them."""

    document_types: list[str] | DataFrame = field(default_factory=list)
    topics: list[str] | DataFrame = field(default_factory=list)
    output_file: str = "text.jsonl"

    def __post_init__(self) -> None:
        _require_list("document_types", self.document_types)
        _require_list("topics", self.topics)
        if self.num_samples_per_prompt > 5:
            warnings.warn("more than 5 samples a prompt tend to repeat each other", UserWarning, stacklevel=3)
        require_placeholders("prompts", self.prompts, ["num_samples", "language_name", "document_type", "topic"])
        require_optional("prompts", self.prompts, self.expansion)


@dataclass(frozen=True)
class ChatConfig:
    """``personas``: texts, or a frame whose first column has them."""

    conversation_continuation_prob: float = 0.5
    max_turns: int = 1
    domain: str = "Science, Technology, Engineering, and Mathematics"
    topics_and_subtopics: Mapping[str, list[str]] = field(default_factory=dict)
    personas: list[str] | DataFrame = field(default_factory=list)
    num_samples: int = 10
    output_file: str = "instruction_dataset.jsonl"
    question_generation_prompts: list[str] | None = None
    persona_question_reformulation_prompt: str | None = None
    simulated_assistant_prompt: str | None = None
    user_followup_prompt: str | None = None
    expansion: Expansion = field(default_factory=Expansion)
    languages: Mapping[str, str] = field(default_factory=lambda: ENGLISH)
    seed: int = 42

    def __post_init__(self) -> None:
        if not 0 <= self.conversation_continuation_prob <= 1:
            raise ValueError("conversation_continuation_prob must lie in [0, 1]")
        if not 1 <= self.max_turns <= 10:
            raise ValueError("max_turns must lie in [1, 10]")
        require_placeholders("question_generation_prompts", self.question_generation_prompts, ["num_samples", "language_name", "domain", "topic", "subtopic"])
        require_optional("question_generation_prompts", self.question_generation_prompts, self.expansion)
        require_placeholders("persona_question_reformulation_prompt", self.persona_question_reformulation_prompt, ["question", "persona", "subtopic"])
        require_placeholders("simulated_assistant_prompt", self.simulated_assistant_prompt, ["domain", "topic", "subtopic", "question"])
        require_placeholders("user_followup_prompt", self.user_followup_prompt, ["dialog_summary", "persona", "domain", "subtopic"])

    @property
    def spoken(self) -> Mapping[str, str]:
        return self.languages or ENGLISH


@dataclass(frozen=True)
class Source:
    """Where rows come from: a frame, a mirrored hub dataset or a local file; they win in this order."""

    frame: DataFrame | None = None
    hf_dataset_name: str | None = None
    local_file_path: str | None = None
    #: Of a CSV or JSON Lines file; without one its types are inferred.
    schema: str | None = None

    def check(self) -> None:
        if self.frame is None and not self.hf_dataset_name and not self.local_file_path:
            raise ValueError("a source is needed: a frame, hf_dataset_name or local_file_path")


@dataclass(frozen=True)
class MCQConfig(_Base):
    source: Source = field(default_factory=Source)
    text_column: str = ""
    context_column: str | None = None
    num_samples_per_prompt: int = 3
    sample_count: int | None = None
    min_document_length: int = 100
    max_document_length: int = 10_000
    distractor_prompt: str | None = None
    output_file: str = "mcq.jsonl"

    def __post_init__(self) -> None:
        self.source.check()
        _require_list("text_column", self.text_column)
        require_placeholders("prompts", self.prompts, ["num_samples", "language_name", "document"])
        require_optional("prompts", self.prompts, self.expansion)
        require_placeholders("distractor_prompt", self.distractor_prompt, ["language_name", "question", "correct_answer"])


@dataclass(frozen=True)
class PreferenceConfig:
    """``input_documents``: texts, or a frame with the column ``document_column``."""

    input_documents: list[str] | DataFrame = field(default_factory=list)
    document_column: str = "text"
    num_samples_per_prompt: int = 3
    question_generation_prompts: list[str] | None = None
    chosen_response_generation_prompt: str | None = None
    rejected_response_generation_prompt: str | None = None
    evolution_prompt: str | None = None
    judge_prompt: str | None = None
    evol_instruct: bool = False
    llm_as_judge: bool = False
    output_file: str = "preference.jsonl"
    expansion: Expansion | None = None
    languages: Mapping[str, str] = field(default_factory=lambda: ENGLISH)
    seed: int = 42

    def __post_init__(self) -> None:
        if self.expansion is not None and self.expansion.placeholders:
            raise ValueError("preference pairs take no expansion")
        require_placeholders("question_generation_prompts", self.question_generation_prompts, ["num_samples", "language_name", "document"])
        for name in ("chosen_response_generation_prompt", "rejected_response_generation_prompt"):
            require_placeholders(name, getattr(self, name), ["language_name", "document", "question"])
        require_placeholders("judge_prompt", self.judge_prompt, ["document", "question", "response"])
        require_placeholders("evolution_prompt", self.evolution_prompt, ["document", "question", "answer"])

    @property
    def spoken(self) -> Mapping[str, str]:
        return self.languages or ENGLISH


@dataclass(frozen=True)
class GenericConfig(_Base):
    source: Source = field(default_factory=Source)
    input_columns: list[str] = field(default_factory=list)
    forward_columns: list[str] | None = None
    output_columns: list[str] | None = None
    num_samples_per_prompt: int = 1
    skip_function: Skip | None = None
    sample_count: int | None = None
    output_file: str = "generic_pipeline.jsonl"

    def __post_init__(self) -> None:
        self.source.check()
        _require_list("input_columns", self.input_columns)
        _require_list("prompts", self.prompts)
        clash = {"num_samples", "language"} & set(self.input_columns)
        if clash:
            raise ValueError(f"input columns may not be called {', '.join(sorted(clash))}")
        if self.num_samples_per_prompt > 10:
            warnings.warn("more than 10 samples a prompt tend to repeat each other", UserWarning, stacklevel=3)
        require_placeholders("prompts", self.prompts, ["num_samples", "language"])
        require_optional("prompts", self.prompts, self.expansion)
        for i, prompt in enumerate(self.prompts or []):
            there = [c for c in self.input_columns if f"{{{c}}}" in prompt]
            if not there:
                raise ValueError(f"prompts[{i}] names no input column")
            if len(there) < len(self.input_columns):
                warnings.warn(f"prompts[{i}] leaves out {', '.join(c for c in self.input_columns if c not in there)}", UserWarning, stacklevel=3)
