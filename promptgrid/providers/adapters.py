"""Network providers, over the services' HTTP interfaces with the standard library.

They can't be exercised without a network; what they send and read is tested against a fake ``post``. A key is an argument
or read from the environment of the executor when a request is made. A key given as an argument travels to the executors
inside the pickled provider, which no plan or log shows; the environment is the safer way. A reply shape is sent as a JSON
schema, so that a service that can hold its replies to one does.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
import warnings
from typing import Any

from promptgrid.providers.base import Messages, Provider, RateLimitError
from promptgrid.schemas import Shape, json_schema


class _Http(Provider):
    env_key = ""
    url = ""

    def __init__(self, model_id: str | None = None, temperature: float | None = None, max_completion_tokens: int | None = None, top_p: float | None = None, frequency_penalty: float | None = None, timeout: float = 120, rpm_limit: float | None = None, api_key: str | None = None):
        self.api_key = api_key
        self.model_id = model_id or self.model_id
        self.temperature, self.max_completion_tokens, self.top_p, self.frequency_penalty = temperature, max_completion_tokens, top_p, frequency_penalty
        self.timeout, self.rpm_limit = timeout, rpm_limit

    def key(self) -> str:
        key = self.api_key or os.environ.get(self.env_key)
        if not key:
            raise ValueError(f"give an api_key or set {self.env_key}")
        return key

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.model_id!r})"

    def headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.key()}"}

    def body(self, conversation: Messages, shape: Shape | None) -> dict[str, Any]:
        options = {"temperature": self.temperature, "max_tokens": self.max_completion_tokens, "top_p": self.top_p, "frequency_penalty": self.frequency_penalty}
        if shape is not None:
            options["response_format"] = {"type": "json_schema", "json_schema": {"name": "reply", "schema": json_schema(shape), "strict": True}}
        return {"model": self.model_id, "messages": conversation} | {k: v for k, v in options.items() if v is not None}

    def content(self, reply: dict[str, Any]) -> str:
        return reply["choices"][0]["message"]["content"]

    def post(self, body: dict[str, Any]) -> dict[str, Any]:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"} | self.headers())
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise RateLimitError(str(e)) from e
            raise

    def complete(self, conversations: list[Messages], shape: Shape | None) -> list[str | Exception]:
        out: list[str | Exception] = []
        for conversation in conversations:
            try:
                out.append(self.content(self.post(self.body(conversation, shape))))
            except RateLimitError:
                if len(conversations) == 1:
                    raise
                out.append(RateLimitError("refused"))
            except Exception as e:  # an item's failure is a value here
                out.append(e)
        return out


class OpenAIProvider(_Http):
    """Uses the responses interface: no system message, no JSON suffix, no second attempt."""

    provider_name, model_id, env_key, url = "openai", "gpt-5-mini-2025-08-07", "OPENAI_API_KEY", "https://api.openai.com/v1/responses"
    json_suffix, system, attempts = False, False, 1

    def __init__(self, model_id: str | None = None, reasoning_effort: str = "low", max_completion_tokens: int | None = None, timeout: float = 120, api_key: str | None = None, **ignored: Any):
        if ignored:
            warnings.warn(f"not supported by this provider: {', '.join(sorted(ignored))}", UserWarning, stacklevel=2)
        super().__init__(model_id, max_completion_tokens=max_completion_tokens, timeout=timeout, api_key=api_key)
        self.reasoning_effort = reasoning_effort

    def body(self, conversation: Messages, shape: Shape | None) -> dict[str, Any]:
        body: dict[str, Any] = {"model": self.model_id, "input": conversation, "reasoning": {"effort": self.reasoning_effort}}
        if self.max_completion_tokens is not None:
            body["max_output_tokens"] = self.max_completion_tokens
        if shape is not None:
            body["text"] = {"format": {"type": "json_schema", "name": "reply", "schema": json_schema(shape), "strict": True}}
        return body

    def content(self, reply: dict[str, Any]) -> str:
        return next(o for o in reply["output"] if o.get("type") == "message")["content"][0]["text"]


class AnthropicProvider(_Http):
    provider_name, model_id, env_key, url = "anthropic", "claude-haiku-4-5-20251001", "ANTHROPIC_API_KEY", "https://api.anthropic.com/v1/messages"

    def __init__(self, model_id: str | None = None, temperature: float | None = None, max_completion_tokens: int | None = None, timeout: float = 120, api_key: str | None = None):
        super().__init__(model_id, temperature, max_completion_tokens, timeout=timeout, api_key=api_key)

    def headers(self) -> dict[str, str]:
        return {"x-api-key": self.key(), "anthropic-version": "2023-06-01"}

    def body(self, conversation: Messages, shape: Shape | None) -> dict[str, Any]:
        system = "\n".join(m["content"] for m in conversation if m["role"] == "system")
        body = super().body([m for m in conversation if m["role"] != "system"], None) | ({"system": system} if system else {})
        if shape is not None:  # a tool whose input is the reply
            body |= {"tools": [{"name": "reply", "description": "Gives the reply.", "input_schema": json_schema(shape)}], "tool_choice": {"type": "tool", "name": "reply"}}
        return {"max_tokens": 4096} | body

    def content(self, reply: dict[str, Any]) -> str:
        given = [c["input"] for c in reply["content"] if c["type"] == "tool_use"]
        return json.dumps(given[0]) if given else "".join(c["text"] for c in reply["content"] if c["type"] == "text")


class GeminiProvider(_Http):
    provider_name, model_id, env_key = "gemini", "gemini-2.0-flash", "GEMINI_API_KEY"
    url = "https://generativelanguage.googleapis.com/v1beta/openai/chat/completions"


class OllamaProvider(_Http):
    """``api_base`` or OLLAMA_API_BASE, by default the local server; no key."""

    provider_name, model_id, env_key = "ollama_chat", "gemma3:4b", "OLLAMA_API_BASE"

    def __init__(self, model_id: str | None = None, api_base: str | None = None, **options: Any):
        super().__init__(model_id, **options)
        self.api_base = api_base

    def headers(self) -> dict[str, str]:
        return {}

    @property
    def url(self) -> str:  # type: ignore[override]
        return (self.api_base or os.environ.get(self.env_key) or "http://localhost:11434") + "/v1/chat/completions"


class OpenRouterProvider(_Http):
    provider_name, model_id, env_key, url = "openrouter", "openai/gpt-5-mini", "OPENROUTER_API_KEY", "https://openrouter.ai/api/v1/chat/completions"


class MistralProvider(_Http):
    provider_name, model_id, env_key, url = "mistral", "mistral-small-latest", "MISTRAL_API_KEY", "https://api.mistral.ai/v1/chat/completions"
