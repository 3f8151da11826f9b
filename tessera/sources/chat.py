"""A chat endpoint for the language-model seams; off unless a host is configured."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from ..operators.detect import token_cap

HOST, MODEL, CAP = "TESSERA_LLM_HOST", "TESSERA_LLM_MODEL", "TESSERA_LLM_TOKENS"


@dataclass(frozen=True)
class Chat:
    """One chat call a prompt, temperature 0, answers capped; ``send`` can be replaced in tests."""

    host: str
    model: str
    cap: int | None = None
    timeout: float = 300.0
    send: Callable[[str, bytes, float], bytes] | None = None

    def complete(self, prompt: str, system: str | None = None) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        options = {"temperature": 0} | ({"num_predict": self.cap} if self.cap else {})
        body = json.dumps({"model": self.model, "messages": messages, "stream": False, "options": options}).encode()
        answer = json.loads((self.send or _post)(f"{self.host.rstrip('/')}/api/chat", body, self.timeout))
        return answer["message"]["content"]

    __call__ = complete


def _post(url: str, body: bytes, timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
        return r.read()


def from_env() -> Chat | None:
    """The configured endpoint, or none."""
    host = os.environ.get(HOST)
    return Chat(host, os.environ.get(MODEL, "default"), token_cap(os.environ.get(CAP))) if host else None


def backend(chat: Chat) -> Callable[[], Callable[[str], str]]:
    """As the detection and mapping seams want it: built on the executor, one a partition."""
    return lambda: chat.complete
