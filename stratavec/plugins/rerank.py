"""Rerankers: local ones, and providers over HTTP (off unless configured)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from stratavec.errors import EngineError
from stratavec.functions.text import words
from stratavec.plugins.http import Transport, send_with_retry, urllib_transport


class Reranker(Protocol):
    """Scores of candidates, in their order; higher is better."""

    max_candidates: int

    def scores(self, query: str, texts: Sequence[str], before: Sequence[float], model: str | None = None) -> list[float]: ...


class Noop:
    """Scores stay as they are."""

    max_candidates = 2**63 - 1

    def scores(self, query, texts, before, model=None):
        return list(before)


class LexicalOverlap:
    """The share of the query's words that a text has; deterministic, for tests and for use without a network."""

    max_candidates = 1000

    def scores(self, query, texts, before, model=None):
        asked = set(words(query))
        return [len(asked & set(words(t))) / len(asked) if asked else 0.0 for t in texts]


#: Fixed values of the providers' public interfaces: where texts and limits go, where scores are, how many candidates.
@dataclass(frozen=True)
class Provider:
    url: str
    auth: tuple[str, str]  # header and its value, {key} replaced
    model: str
    top: str | None = "top_n"
    results: str = "results"
    score: str = "relevance_score"
    max_candidates: int = 1000
    wrap: Callable[[str], object] = str
    extra: dict = field(default_factory=dict)


PROVIDERS = {
    "cohere": Provider("https://api.cohere.com/v2/rerank", ("Authorization", "Bearer {key}"), "rerank-v3.5"),
    "voyage": Provider("https://api.voyageai.com/v1/rerank", ("Authorization", "Bearer {key}"), "rerank-2", top="top_k", results="data", extra={"truncation": True}),
    "jina": Provider("https://api.jina.ai/v1/rerank", ("Authorization", "Bearer {key}"), "jina-reranker-v2-base-multilingual"),
    "pinecone": Provider("https://api.pinecone.io/rerank", ("Api-Key", "{key}"), "pinecone-rerank-v0", results="data", score="score", max_candidates=100, wrap=lambda t: {"text": t}),
}


class HttpReranker:
    """A provider of the table; candidates it doesn't return get the lowest score."""

    def __init__(self, provider: str, key: str, model: str | None = None, retries: int = 3, transport: Transport = urllib_transport):
        if provider not in PROVIDERS:
            raise EngineError("RERANKER_CONFIG", f"unknown reranker {provider!r}")
        if not key:
            raise EngineError("RERANKER_CONFIG", f"no key for reranker {provider!r}")
        self.spec, self.key, self.model, self.retries, self.transport = PROVIDERS[provider], key, model, retries, transport

    @property
    def max_candidates(self) -> int:
        return self.spec.max_candidates

    def scores(self, query, texts, before, model=None):
        if not texts:
            return []
        s = self.spec
        body = {"model": model or self.model or s.model, "query": query, "documents": [s.wrap(t) for t in texts], **s.extra}
        if s.top:
            body[s.top] = len(texts)
        answer = send_with_retry(self.transport, s.url, {s.auth[0]: s.auth[1].format(key=self.key)}, body, self.retries, "RERANKER")
        out = [float("-inf")] * len(texts)
        for r in answer[s.results]:
            out[r["index"]] = float(r[s.score])
        return out


class CrossEncoder:
    """A text-inference server, which cuts long texts itself; no retry, no choice of model."""

    max_candidates = 1000

    def __init__(self, url: str, transport: Transport = urllib_transport):
        self.url, self.transport = url.rstrip("/") + "/rerank", transport

    def scores(self, query, texts, before, model=None):
        if not texts:
            return []
        answer = send_with_retry(self.transport, self.url, {}, {"query": query, "texts": list(texts), "truncate": True}, 0, "RERANKER")
        out = [float("-inf")] * len(texts)
        for r in answer:
            out[r["index"]] = float(r["score"])
        return out


def build_reranker(backend: str = "none", **options) -> Reranker:
    """By name; an unknown one is a no-op with a warning."""
    if backend in PROVIDERS:
        return HttpReranker(backend, **options)
    if backend == "cross-encoder":
        return CrossEncoder(**options)
    if backend == "lexical-overlap":
        return LexicalOverlap()
    if backend not in ("none", ""):
        import warnings

        warnings.warn(f"unknown reranker {backend!r}: scores stay as they are", stacklevel=2)
    return Noop()
