"""Language model providers: what they return, how they are chosen, retried and called.

Providers run on the driver for questions and in tasks for extraction; they are
plain objects that pickle.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from .schema import HttpError, InvalidConfig, LlmError, ProviderNotFound


@dataclass
class Completion:
    text: str
    model: str = "mock"
    prompt_tokens: int = 0
    completion_tokens: int = 0


@dataclass
class Extraction:
    entities: list[dict] = field(default_factory=list)
    relationships: list[dict] = field(default_factory=list)


EXTRACTION_PROMPT = (
    "List the named things in the user's text and how they relate. Reply with one JSON object: "
    '{"entities": [{"name", "kind", "description", "confidence"}], "relationships": [{"src", "dst", "kind", "weight"}]}. '
    "Use names as they are written, relate only listed names, and reply with empty lists if there are none."
)


def parse_extraction(text: str) -> Extraction:
    """Entities with a name and relationships with src, dst and kind; the rest drop, defaults are 1."""
    m = re.search(r"\{.*\}", text, re.S)
    try:
        got = json.loads(m.group(0)) if m else None
    except ValueError as e:
        raise LlmError(f"extraction isn't JSON: {e}") from e
    if not isinstance(got, dict):
        raise LlmError("extraction isn't a JSON object")
    out = Extraction()
    for e in got.get("entities") or []:
        if isinstance(e, dict) and isinstance(e.get("name"), str):
            out.entities.append({"name": e["name"], "kind": e.get("kind"), "description": e.get("description"), "confidence": float(e.get("confidence", 1.0))})
    for r in got.get("relationships") or []:
        if isinstance(r, dict) and all(isinstance(r.get(k), str) for k in ("src", "dst", "kind")):
            out.relationships.append({"src": r["src"], "dst": r["dst"], "kind": r["kind"], "weight": float(r.get("weight", 1.0))})
    return out


class Provider:
    name = "none"

    def complete(self, system: str, prompt: str) -> Completion:
        raise NotImplementedError

    def extract(self, text: str) -> Extraction:
        return parse_extraction(self.complete(EXTRACTION_PROMPT, text).text)


class Mock(Provider):
    """Answers with a fixed text and extracts nothing."""

    name = "mock"

    def __init__(self, answer: str = "Mock answer citing [1]."):
        self.answer = answer

    def complete(self, system: str, prompt: str) -> Completion:
        return Completion(self.answer, "mock", len(prompt.split()), len(self.answer.split()))

    def extract(self, text: str) -> Extraction:
        return Extraction()


class MockExtractor(Mock):
    """Every capitalised word is an entity, and each relates to the next."""

    name = "mock-extractor"

    def extract(self, text: str) -> Extraction:
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+\b", text)))
        return Extraction(
            [{"name": n, "kind": "thing", "description": None, "confidence": 1.0} for n in names],
            [{"src": a, "dst": b, "kind": "related_to", "weight": 1.0} for a, b in zip(names, names[1:])],
        )


def post(url: str, body: dict, headers: dict[str, str], timeout: float = 30) -> dict:
    req = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    try:
        with urllib.request.urlopen(req, timeout=timeout) as r:  # noqa: S310
            return json.loads(r.read())
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, e.read()[:200].decode(errors="replace")) from e
    except urllib.error.URLError as e:
        raise HttpError(503, str(e.reason)) from e


@dataclass
class Http(Provider):
    """A chat endpoint; ``send`` can be replaced, as tests do."""

    model: str
    base_url: str
    credential: str | None = None
    send: Callable[[str, dict, dict[str, str]], dict] = post
    max_tokens: int = 1024


class OpenAI(Http):
    name = "openai"

    def complete(self, system: str, prompt: str) -> Completion:
        head = {"authorization": f"Bearer {self.credential}"} if self.credential else {}
        got = self.send(f"{self.base_url}/chat/completions", {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}, head)
        use = got.get("usage") or {}
        return Completion(got["choices"][0]["message"]["content"], self.model, use.get("prompt_tokens", 0), use.get("completion_tokens", 0))


class Anthropic(Http):
    name = "anthropic"

    def complete(self, system: str, prompt: str) -> Completion:
        got = self.send(f"{self.base_url}/v1/messages", {"model": self.model, "max_tokens": self.max_tokens, "system": system, "messages": [{"role": "user", "content": prompt}]}, {"x-api-key": self.credential or "", "anthropic-version": "2023-06-01"})
        use = got.get("usage") or {}
        text = "".join(p.get("text", "") for p in got.get("content", []))
        return Completion(text, self.model, use.get("input_tokens", 0), use.get("output_tokens", 0))


class Ollama(Http):
    name = "ollama"

    def complete(self, system: str, prompt: str) -> Completion:
        got = self.send(f"{self.base_url}/api/chat", {"model": self.model, "stream": False, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}, {})
        return Completion(got["message"]["content"], self.model, got.get("prompt_eval_count", 0), got.get("eval_count", 0))


#: Where the services listen.
BASE_URLS = {"openai": "https://api.openai.com/v1", "anthropic": "https://api.anthropic.com", "ollama": "http://localhost:11434"}


class Retrying(Provider):
    """Up to three attempts; only failures that another attempt may mend are retried."""

    def __init__(self, inner: Provider, attempts: int = 3, first: float = 1.0, most: float = 10.0, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.attempts, self.first, self.most, self.sleep = inner, attempts, first, most, sleep
        self.name = inner.name

    def _try(self, f: Callable):
        for k in range(self.attempts):
            try:
                return f()
            except HttpError as e:
                if not e.retry or k + 1 == self.attempts:
                    raise
                self.sleep(min(self.first * 2**k, self.most))
        raise AssertionError

    def complete(self, system: str, prompt: str) -> Completion:
        return self._try(lambda: self.inner.complete(system, prompt))

    def extract(self, text: str) -> Extraction:
        return self._try(lambda: self.inner.extract(text))


def build(row: dict, decrypt: Callable[[str], str] | None = None) -> Provider:
    """A provider from its stored row; the credential is decrypted only here."""
    kind = row["provider"]
    if kind == "mock":
        return Mock()
    if kind == "mock-extractor":
        return MockExtractor()
    cls = {"openai": OpenAI, "anthropic": Anthropic, "ollama": Ollama}.get(kind)
    if cls is None:
        raise InvalidConfig(f"unknown provider {kind!r}")
    secret = row.get("credential")
    if secret and secret.startswith("enc:"):
        if decrypt is None:
            raise InvalidConfig("the credential is encrypted and there is no master key")
        secret = decrypt(secret)
    if not row.get("model"):
        raise InvalidConfig(f"provider {row.get('name')!r} has no model")
    return Retrying(cls(row["model"], (row.get("base_url") or BASE_URLS[kind]).rstrip("/"), secret))


def resolve(explicit: str | None, of_namespace: str | None, providers: list[dict]) -> str:
    """Name of the provider to ask: the explicit one, the namespace's, the first for llm."""
    if explicit:
        return explicit
    if of_namespace:
        return of_namespace
    first = next((p["name"] for p in sorted(providers, key=lambda p: p["name"]) if p["kind"] == "llm"), None)
    if first is None:
        raise ProviderNotFound("no provider of kind llm")
    return first
