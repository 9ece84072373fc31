"""Query plans: what a request was compiled to."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Source:
    """dense: vector.  hybrid: vector, text, alpha and bm25_weight."""

    kind: str
    vector: list[float]
    text: str | None = None
    alpha: float = 0.5
    bm25_weight: float = 0.5


@dataclass(frozen=True)
class Stage:
    """kind is rerank, scoreThreshold, dedup, groupBy or truncate."""

    kind: str
    args: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    source: Source
    namespace: str
    retrieve_k: int
    top_k: int
    filter: dict | None = None
    stages: tuple[Stage, ...] = ()
    include_values: bool = False
    include_metadata: bool = False

    @property
    def grouped(self) -> bool:
        return any(s.kind == "groupBy" for s in self.stages)

    def needs_metadata(self) -> bool:
        return self.include_metadata or any(s.kind in ("rerank", "dedup", "groupBy") for s in self.stages)

    def explain(self) -> dict:
        """The plan as JSON, by the names of the wire format."""
        s = self.source
        source = {"kind": s.kind, "vector": list(s.vector)}
        if s.kind == "hybrid":
            source |= {"text": s.text, "alpha": s.alpha, "bm25_weight": s.bm25_weight}
        out = {"source": source, "namespace": self.namespace, "retrieveK": self.retrieve_k, "topK": self.top_k}
        out["stages"] = [{"kind": t.kind, **{k: v for k, v in t.args.items() if v is not None}} for t in self.stages]
        out["output"] = {"includeValues": self.include_values, "includeMetadata": self.include_metadata}
        return out if self.filter is None else out | {"filter": self.filter}
