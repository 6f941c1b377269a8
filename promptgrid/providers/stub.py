"""Offline providers."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from promptgrid.providers.base import JSON_SUFFIX, Messages, Provider, RateLimitError
from promptgrid.schemas import Checked, Long, Maybe, Shape


class StubProvider(Provider):
    """Replies that are a function of model, prompt and place: ``txt-`` and an MD5, scores from 1 to 10.

    ``entries``: elements of every list in a reply. Replies come as fenced JSON, so that stripping and parsing run.
    """

    provider_name = "stub"

    def __init__(self, model_id: str = "stub-1", entries: int = 2, fenced: bool = True, rpm_limit: float | None = None):
        self.model_id, self.entries, self.fenced, self.rpm_limit = model_id, entries, fenced, rpm_limit

    def _value(self, shape: Shape, name: str, k: int, prompt: bytes) -> Any:
        if isinstance(shape, (Maybe, Checked)):
            return self._value(shape.shape, name, k, prompt)
        if isinstance(shape, dict):
            return {f: self._value(s, f, k, prompt) for f, s in shape.items()}
        if isinstance(shape, list):
            return [self._value(shape[0], name, i, prompt) for i in range(self.entries)]
        digest = hashlib.md5(f"{self.model_id}|{name}|{k}|".encode() + prompt).hexdigest()
        if shape is str:
            return f"txt-{digest}"
        number = int(digest[:8], 16) % 10 + 1
        return {int: number, Long: number, float: number / 10, bool: number > 5}.get(shape, f"txt-{digest}")

    def complete(self, conversations: list[Messages], shape: Shape | None) -> list[str | Exception]:
        return [self._one(next(m["content"] for m in reversed(c) if m["role"] == "user").removesuffix(JSON_SUFFIX), shape) for c in conversations]

    def _one(self, prompt: str, shape: Shape | None) -> str:
        if shape is None:
            return self._value(str, "text", 0, prompt.encode())
        reply = json.dumps(self._value(shape, "", 0, prompt.encode()))
        return f"```json\n{reply}\n```" if self.fenced else reply


def stub_sql(prompt: str, model: str, name: str, k: str = "0") -> str:
    """DuckDB SQL of a stub's text."""
    return f"'txt-' || md5({model} || '|{name}|' || {k} || '|' || {prompt})"


def stub_score_sql(prompt: str, model: str, name: str = "score") -> str:
    return f"(('0x' || substr(md5({model} || '|{name}|0|' || {prompt}), 1, 8))::BIGINT % 10 + 1)::INT"


class ScriptedProvider(StubProvider):
    """A stub with canned replies and faults by substrings of the prompt.

    ``canned``: substring -> reply. ``failing``: substrings whose prompts fail, each time. ``refused``: refusals for rate
    before the first success, in each task.
    """

    def __init__(self, model_id: str = "scripted-1", entries: int = 2, canned: dict[str, str] | None = None, failing: tuple[str, ...] = (), refused: int = 0):
        super().__init__(model_id, entries)
        self.canned, self.failing, self.refused = canned or {}, failing, refused

    def complete(self, conversations: list[Messages], shape: Shape | None) -> list[str | Exception]:
        if self.refused:
            self.refused -= 1
            raise RateLimitError("slow down")
        return super().complete(conversations, shape)

    def _one(self, prompt: str, shape: Shape | None) -> Any:
        if any(f in prompt for f in self.failing):
            return RuntimeError("scripted failure")
        return next((reply for part, reply in self.canned.items() if part in prompt), None) or super()._one(prompt, shape)
