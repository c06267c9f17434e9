"""Models behind one small interface; the default answers without a network, always alike."""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol


class ChatModel(Protocol):
    def stream(self, prompt: str) -> Iterator[str]: ...


class StubChat:
    """Quotes the first context block; for prompts of numbered chunks it extracts one item per chunk as JSON."""

    def stream(self, prompt: str) -> Iterator[str]:
        blocks = re.findall(r"\[chunk (\d+)\] [^\n]*\n(.*?)(?=\n\n\[chunk |\Z)", prompt, re.S)
        if blocks:
            items = [{"kind": "concept", "title": " ".join(t.split()[:4]), "summary": t.split("\n")[0][:200], "evidence": [{"chunkId": int(i), "quote": " ".join(t.split()[:8])}], "links": []} for i, t in blocks if t.strip()]
            yield json.dumps({"items": items})
        else:
            for word in ("From", "the", "notes:", *prompt.split("\n")[0].split()[:20]):
                yield word + " "


def answer(model: ChatModel, prompt: str) -> str:
    return "".join(model.stream(prompt))


def event_payloads(lines: Iterator[str]) -> Iterator[dict]:
    """JSON payloads of data: lines of an event stream up to [DONE]; others are ignored."""
    for line in lines:
        if not line.startswith("data:"):
            continue
        data = line[5:].strip()
        if data == "[DONE]":
            return
        try:
            value = json.loads(data)
        except ValueError:
            continue
        if isinstance(value, dict):
            yield value


def payload_text(value: dict) -> str:
    """The text that an event adds, for both common dialects."""
    delta = value.get("delta")
    if isinstance(delta, dict):
        return delta.get("text") or ""
    choices = value.get("choices") or [{}]
    return (choices[0].get("delta") or {}).get("content") or ""


@dataclass
class HttpChat:
    """A model behind one of the two common streaming interfaces, at an address that the settings name.

    dialect: "messages" (events with a delta's text) or "completions" (events with choices). The key comes from the
    environment variable key_variable, if one is named and set, else from `key`; headers are sent besides.
    """

    dialect: str
    model: str
    base_url: str
    key: str = ""
    key_variable: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    max_tokens: int = 4096
    timeout: float = 60.0

    def request(self, prompt: str) -> urllib.request.Request:
        if self.dialect not in ("messages", "completions"):
            raise ValueError(f"unknown dialect: {self.dialect!r}")
        key = (os.environ.get(self.key_variable, "") if self.key_variable else "") or self.key
        body = {"model": self.model, "stream": True, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": prompt}]}
        path = "/v1/messages" if self.dialect == "messages" else "/chat/completions"
        sign = {} if not key else {"x-api-key": key} if self.dialect == "messages" else {"authorization": f"Bearer {key}"}
        return urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(body).encode(), {"content-type": "application/json", **sign, **self.headers})

    def stream(self, prompt: str) -> Iterator[str]:
        with urllib.request.urlopen(self.request(prompt), timeout=self.timeout) as reply:
            for value in event_payloads(line.decode().rstrip("\n") for line in reply):
                if text := payload_text(value):
                    yield text


def probe(model: ChatModel, seconds: float = 15.0) -> bool:
    """Whether the model gives a first piece of an answer within the time."""
    from concurrent.futures import ThreadPoolExecutor
    from concurrent.futures import TimeoutError as TookTooLong

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(lambda: next(iter(model.stream("ping")), None)).result(seconds) is not None
    except TookTooLong:
        return False
    finally:
        pool.shutdown(wait=False)
