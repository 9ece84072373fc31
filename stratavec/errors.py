"""Errors a caller can tell apart by code."""

from __future__ import annotations

#: The codes of the service's contract and the status each is answered with.
STATUS = {
    "INVALID_ARGUMENT": 400,
    "NOT_FOUND": 404,
    "ALREADY_EXISTS": 409,
    "PERMISSION_DENIED": 403,
    "INTERNAL": 500,
    "DIMENSION_MISMATCH": 400,
    "SPARSE_NOT_SUPPORTED": 400,
    "FILTER_MALFORMED": 400,
    "FILTER_UNSUPPORTED_OPERATOR": 400,
    "HYBRID_REQUIRES_BM25": 400,
    "GROUPBY_FIELD_MISSING": 400,
    "FACET_FIELD_INVALID": 400,
    "INDEX_NOT_READY": 409,
    "COLLECTION_NOT_FOUND": 404,
    "COLLECTION_ALREADY_EXISTS": 409,
    "RERANKER_RATE_LIMITED": 429,
    "RERANKER_TIMEOUT": 504,
    "RERANKER_CONFIG": 503,
    "RERANKER_UPSTREAM": 502,
    "EMBEDDER_CONFIG": 503,
    "EMBEDDER_UPSTREAM": 502,
    "EMBEDDER_RATE_LIMITED": 429,
    "EMBEDDER_TIMEOUT": 504,
    "EMBEDDER_DIMENSION_MISMATCH": 400,
    "TEXT_REQUIRED": 400,
    "VALUES_AND_TEXT_CONFLICT": 400,
}


class EngineError(Exception):
    """``code`` names the kind of error, ``details`` what it is about."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(message)
        self.code, self.message, self.details = code, message, details

    @property
    def status(self) -> int:
        return STATUS[self.code]

    def body(self) -> dict:
        error = {"code": self.code, "message": self.message}
        if self.details:
            error["details"] = self.details
        return {"status": self.status, "error": error}


def invalid(message: str, **details) -> EngineError:
    return EngineError("INVALID_ARGUMENT", message, **details)
