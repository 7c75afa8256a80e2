"""Documents from a language model: a client protocol, a scripted client, structured answers."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol, TypeVar

from ..sources.store import LLMCallInfo, now

T = TypeVar("T")


class ParseError(ValueError):
    """Two answers in a row could not be read."""


class Client(Protocol):
    """A client may also have a ``temperature`` and a ``seed``; they are logged where it has them."""

    model: str

    def complete(self, prompt: str, context: str) -> str: ...


@dataclass
class ScriptedClient:
    """Gives the answers of a list, in order. For tests and replays; it opens no connection."""

    answers: list[str]
    model: str = "scripted"
    calls: list[tuple[str, str]] = field(default_factory=list)

    def complete(self, prompt: str, context: str) -> str:
        self.calls.append((prompt, context))
        if not self.answers:
            raise RuntimeError("the script has no further answer")
        return self.answers.pop(0)


def json_text(answer: str) -> str:
    """An answer without a code fence about it."""
    m = re.search(r"```(?:json)?\s*\n(.*?)```", answer, re.S)
    return (m[1] if m else answer).strip()


def call_info(client: Client, prompt: str) -> LLMCallInfo:
    """What a question is asked with."""
    return LLMCallInfo(client.model, hashlib.sha256(prompt.encode()).hexdigest(), getattr(client, "temperature", None), getattr(client, "seed", None))


def structured(client: Client, prompt: str, context: dict, read: Callable[[dict], T], log: Path | None = None) -> T:
    """One question, asked again with the complaint if the answer does not read; ParseError after that.
    Every answer is appended to ``log`` as a line of JSON."""
    said, complaint = json.dumps(context, default=str, sort_keys=True), ""
    for attempt in (1, 2):
        asked = now()
        answer = client.complete(prompt, said + complaint)
        if log is not None:
            with log.open("a", encoding="utf-8") as f:
                f.write(json.dumps({"asked_utc": asked, "attempt": attempt, **call_info(client, prompt).to_dict(), "prompt": prompt, "context": said + complaint, "answer": answer}) + "\n")
        try:
            return read(json.loads(json_text(answer)))
        except (ValueError, TypeError, KeyError) as e:
            complaint = f"\n\nThe last answer could not be used: {e}"
    raise ParseError(complaint.strip())
