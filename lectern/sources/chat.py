"""An extractor over a chat model that is asked for answers in a schema.

A model may take a schema as the answer's format or as a tool to call. The first way that gives a valid answer
is kept for all later calls, also by the workers that the extractor is sent to.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from typing import Any, Protocol

from lectern.operators.enrich import validated

#: Ways to ask for a schema, the stricter one first.
WAYS = ("json_schema", "function_calling")


class Chat(Protocol):
    def ask(self, messages: list[dict[str, str]], schema: dict[str, Any], way: str) -> dict: ...


class HttpChat:
    """A chat endpoint that takes a model, messages, options and a format or tools, and answers with one message."""

    def __init__(self, url: str, model: str, num_ctx: int, timeout: float = 600.0):
        self.url, self.model, self.num_ctx, self.timeout = url, model, num_ctx, timeout

    def ask(self, messages: list[dict[str, str]], schema: dict[str, Any], way: str) -> dict:
        body: dict[str, Any] = {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": 0, "num_ctx": self.num_ctx}}
        if way == "json_schema":
            body["format"] = schema
        else:
            body["tools"] = [{"type": "function", "function": {"name": "answer", "description": "Gives the answer.", "parameters": schema}}]
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            message = json.load(response)["message"]
        answer = message["content"] if way == "json_schema" else message["tool_calls"][0]["function"]["arguments"]
        return json.loads(answer) if isinstance(answer, str) else answer


class ChatExtractor:
    """Asks a chat model, by the way that it honours.

    make_chat(model, num_ctx) builds the client, once in each process; it has to be picklable. ``validate``
    gives an answer's fields or raises: a way is kept for an answer that passes, not for one that merely parses.
    ``way`` spares the search for one.
    """

    def __init__(
        self, model: str, make_chat: Callable[[str, int], Chat], num_ctx: int = 16384, way: str | None = None, validate: Callable[[Any], dict] = validated
    ):
        self.model, self.make_chat, self.num_ctx, self.way, self.validate = model, make_chat, num_ctx, way, validate
        self._chat: Chat | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_chat": None}

    def extract(self, prompt: str, schema: dict[str, Any], *, system: str | None = None) -> dict:
        if self._chat is None:
            self._chat = self.make_chat(self.model, self.num_ctx)
        messages = [{"role": "user", "content": prompt}]
        if system:
            messages.insert(0, {"role": "system", "content": system})
        failures = []
        for way in [self.way] if self.way else WAYS:
            try:
                answer = self.validate(self._chat.ask(messages, schema, way))
            except Exception as e:  # this way isn't supported, failed, or gave no valid answer: the next one may work
                failures.append(f"{way}: {e}")
                continue
            self.way = way
            return answer
        raise ValueError(f"{self.model} gave no answer ({'; '.join(failures)})")


def http_extractor(model: str, url: str) -> ChatExtractor:
    return ChatExtractor(model, _Endpoint(url))


class _Endpoint:
    def __init__(self, url: str):
        self.url = url

    def __call__(self, model: str, num_ctx: int) -> HttpChat:
        return HttpChat(self.url, model, num_ctx)
