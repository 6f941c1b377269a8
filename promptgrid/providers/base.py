"""What all providers share: input checks, message building, request limit, retries, parsing."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from typing import Any

from promptgrid.logs import log
from promptgrid.schemas import Checked, Shape, parse, shape_of


Messages = list[dict[str, str]]
SYSTEM = "You are a helpful assistant."
JSON_SUFFIX = "\nReply with one JSON value and nothing around it, no code fence either. Quote keys and strings with double quotes, escape quotes and line ends inside them, and leave no comma before a closing bracket."
ATTEMPTS = 3
FIRST_WAIT = 5.0
WINDOW = 60.0
WAIT_TARGET = 62.0


class RateLimitError(RuntimeError):
    """The service refused a request because of its rate."""


class RequestLimit:
    """At most ``max(1, int(rpm * 0.9))`` requests in any 60 seconds; a caller at the limit waits until the oldest is 62
    seconds old. In a stage of n tasks each holds rpm / n."""

    def __init__(self, rpm: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rpm, self.clock, self.sleep = rpm, clock, sleep
        self.sent: deque[float] = deque()

    def threshold(self) -> int:
        return max(1, int(self.rpm * 0.9))

    def wait(self) -> None:
        if self.rpm is None:
            return
        self._forget()
        if len(self.sent) >= self.threshold():
            pause = WAIT_TARGET - (self.clock() - self.sent[0])
            if pause > 0:
                log.warning("request limit near, waiting %.1f s", pause)
                self.sleep(pause)
                self._forget()

    def record(self, requests: int) -> None:
        if self.rpm is not None:
            self.sent.extend([self.clock()] * requests)

    def _forget(self) -> None:
        now = self.clock()
        while self.sent and now - self.sent[0] >= WINDOW:
            self.sent.popleft()


class Provider:
    """Subclasses set ``provider_name`` and ``model_id`` and define ``complete``."""

    provider_name = "none"
    model_id = "none"
    rpm_limit: float | None = None
    json_suffix = True
    system = True
    attempts = ATTEMPTS

    def model(self) -> str:
        return f"{self.provider_name}/{self.model_id}"

    def complete(self, conversations: list[Messages], shape: Shape | None) -> list[str | Exception]:
        """Replies of one batch; an exception as an item is that item's failure, one raised is the batch's."""
        raise NotImplementedError

    def limit(self, tasks: int = 1) -> RequestLimit:
        return RequestLimit(None if self.rpm_limit is None else self.rpm_limit / tasks)

    def conversation(self, prompt: str | Messages, shape: Shape | None) -> Messages:
        """A prompt or conversation as it is sent; the caller's messages are left alone."""
        suffix = JSON_SUFFIX if shape is not None and self.json_suffix else ""
        if isinstance(prompt, str):
            user = {"role": "user", "content": prompt + suffix}
            return [{"role": "system", "content": SYSTEM}, user] if self.system else [user]
        sent = [dict(m) for m in prompt]
        for m in reversed(sent):
            if m.get("role") == "user":
                m["content"] += suffix
                break
        return sent

    def send(self, batch: list[Messages], shape: Shape | None, limit: RequestLimit | None = None, sleep: Callable[[float], None] = time.sleep) -> list[str | Exception]:
        """``complete`` under the request limit, tried again after refusals: waits of 5 and 10 seconds."""
        limit = limit or self._own_limit()
        limit.wait()
        for attempt in range(self.attempts):
            try:
                replies = self.complete(batch, shape)
                break
            except RateLimitError:
                if attempt == self.attempts - 1:
                    raise
                sleep(FIRST_WAIT * 2**attempt)
        limit.record(len(batch))
        return replies

    def _own_limit(self) -> RequestLimit:
        if not hasattr(self, "_limit"):
            self._limit = self.limit()
        return self._limit

    def generate(self, prompt: str | list[str] | None = None, messages: Messages | list[Messages] | None = None, response_format: Shape | None = None) -> Any:
        """One reply for one prompt or conversation, a list for a list. Any failed item fails the call.

        response_format: a shape, a Spark type or its DDL, or a model class, whose instances are then returned.
        """
        response_format = shape_of(response_format)
        if (prompt is None) == (messages is None):
            raise ValueError("give either prompt or messages")
        if prompt is not None:
            if not isinstance(prompt, (str, list)):
                raise ValueError("prompt must be a string or a list of strings")
            single = isinstance(prompt, str)
            items: list[Any] = [prompt] if single else prompt
        else:
            if not isinstance(messages, list) or not messages:
                raise ValueError("messages must not be empty")
            if not isinstance(messages[0], (dict, list)):
                raise ValueError("messages must be a conversation or a list of conversations")
            single = isinstance(messages[0], dict)
            items = [messages] if single else messages
        try:
            replies = self.send([self.conversation(i, response_format) for i in items], response_format)
            for i, reply in enumerate(replies):
                if isinstance(reply, Exception):
                    raise RuntimeError(f"item {i} failed: {reply}") from reply
            parsed = [parse(response_format, r) for r in replies]
            if isinstance(response_format, Checked):
                parsed = [response_format.model.model_validate(p) for p in parsed]
        except Exception as e:
            raise RuntimeError(f"{self.model()}: {e}") from e
        return parsed[0] if single else parsed
