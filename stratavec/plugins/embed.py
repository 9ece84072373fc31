"""Embedders: a local one, and providers over HTTP (off unless configured)."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stratavec.errors import EngineError
from stratavec.functions.text import words
from stratavec.plugins.http import Transport, send_with_retry, urllib_transport


class Embedder(Protocol):
    """One vector a text, in order; ``kind`` is document or query."""

    backend: str
    model: str
    max_batch: int

    def embed(self, texts: Sequence[str], kind: str) -> list[list[float]]: ...


class HashProjection:
    """Sums of pseudo-random signs of a text's words, to length 1; deterministic, without a model."""

    backend, max_batch = "hash-projection", 1024

    def __init__(self, model: str = "96"):
        self.model, self.dim = model, int(model)

    def embed(self, texts, kind="document"):
        import xxhash

        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in words(t):
                rng = np.random.default_rng(xxhash.xxh3_64_intdigest(w))
                v += rng.standard_normal(self.dim)
            n = np.sqrt(v @ v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out


#: Fixed values of the providers' public interfaces.
@dataclass(frozen=True)
class Provider:
    url: str
    max_batch: int
    texts: str = "input"
    kind: str | None = None
    kinds: tuple[str, str] = ("document", "query")
    answer: Callable[[dict], list] = lambda a: [d["embedding"] for d in sorted(a["data"], key=lambda d: d["index"])]


PROVIDERS = {
    "openai": Provider("https://api.openai.com/v1/embeddings", 2048),
    "voyage": Provider("https://api.voyageai.com/v1/embeddings", 128, kind="input_type"),
    "cohere": Provider("https://api.cohere.com/v2/embed", 96, "texts", "input_type", ("search_document", "search_query"), lambda a: a["embeddings"]["float"]),
    "jina": Provider("https://api.jina.ai/v1/embeddings", 2048, kind="task", kinds=("retrieval.passage", "retrieval.query")),
    "huggingface-tei": Provider("", 32, "inputs", answer=list),
}


class HttpEmbedder:
    def __init__(self, backend: str, model: str, key: str | None = None, url: str | None = None, retries: int = 3, transport: Transport = urllib_transport):
        self.backend, self.model, self.spec = backend, model, PROVIDERS[backend]
        self.max_batch, self.url, self.retries, self.transport = self.spec.max_batch, url or self.spec.url, retries, transport
        self.headers = {"Authorization": f"Bearer {key}"} if key else {}

    def embed(self, texts, kind="document"):
        s = self.spec
        body = {s.texts: list(texts)} | ({} if self.backend == "huggingface-tei" else {"model": self.model})
        if s.kind:
            body[s.kind] = s.kinds[kind == "query"]
        if self.backend == "cohere":
            body["embedding_types"] = ["float"]
        return s.answer(send_with_retry(self.transport, self.url, self.headers, body, self.retries, "EMBEDDER"))


class EmbedderFactory:
    """Embedders by (backend, model), built once."""

    def __init__(self, keys: dict[str, str] | None = None, tei_url: str | None = None, transport: Transport = urllib_transport):
        self.keys, self.tei_url, self.transport, self.made = keys or {}, tei_url, transport, {}

    def get(self, config: dict) -> Embedder:
        at = (config.get("backend"), config.get("model"))
        if at not in self.made:
            self.made[at] = self._build(*at)
        return self.made[at]

    def _build(self, backend, model):
        if backend == "hash-projection":
            return HashProjection(model or "96")
        if backend == "tei":
            backend = "huggingface-tei"
        if backend not in PROVIDERS:
            raise EngineError("EMBEDDER_CONFIG", f"unknown embedder backend {backend!r}")
        if backend == "huggingface-tei":
            if not self.tei_url:
                raise EngineError("EMBEDDER_CONFIG", f"no address for embedder {backend!r}")
            return HttpEmbedder(backend, model, url=self.tei_url.rstrip("/") + "/embed", retries=0, transport=self.transport)
        if not self.keys.get(backend):
            raise EngineError("EMBEDDER_CONFIG", f"no key for embedder {backend!r}")
        return HttpEmbedder(backend, model, self.keys[backend], transport=self.transport)


def embed_all(embedder: Embedder, texts: Sequence[str], kind: str = "document") -> list[list[float]]:
    """Vectors in the order of the texts, asked for in batches of the embedder's size."""
    step, out = max(1, embedder.max_batch), []
    for k in range(0, len(texts), step):
        out.extend(embedder.embed(texts[k : k + step], kind))
    return out


def embed_column(embedder: Embedder, kind: str = "document"):
    """The embedder as a column function, over Arrow batches; null texts give null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        there = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        found = embed_all(embedder, list(texts[there]), kind)
        for at, v in zip(texts.index[there], found):
            out[at] = v
        return out

    return run


class QueryCache:
    """Vectors of query texts, the most recent ``capacity`` of the last ``ttl`` seconds; blanks around a text don't matter."""

    def __init__(self, capacity: int = 10_000, ttl: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.capacity, self.ttl, self.clock, self.kept = capacity, ttl, clock, OrderedDict()

    def get(self, embedder: Embedder, text: str, fresh: bool = False) -> list[float]:
        key = f"{embedder.backend}|{embedder.model}|{text.strip()}"
        hit = self.kept.get(key)
        if hit and not fresh and self.clock() - hit[0] < self.ttl:
            self.kept.move_to_end(key)
            return hit[1]
        vector = embed_all(embedder, [text], "query")[0]
        self.kept[key] = (self.clock(), vector)
        self.kept.move_to_end(key)
        while len(self.kept) > self.capacity:
            self.kept.popitem(last=False)
        return vector
