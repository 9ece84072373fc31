"""Collections and aliases, in one small JSON file."""

from __future__ import annotations

import re
import uuid
from datetime import UTC, datetime

from stratavec.errors import EngineError, invalid
from stratavec.operators.browse import check_metric
from stratavec.sources.files import Folder

_NAME = re.compile(r"[a-z0-9](?:[a-z0-9-]{0,43}[a-z0-9])?\Z")


def check_name(name: str) -> None:
    if not isinstance(name, str) or not _NAME.match(name):
        raise invalid("a name has 1 to 45 lower-case letters, digits and inner hyphens", name=name)


def _now() -> str:
    return datetime.now(UTC).isoformat()


class Catalog:
    def __init__(self, root: Folder):
        self.root = root

    def _load(self) -> dict:
        return self.root.read("catalog.json") or {"collections": {}, "aliases": {}}

    def _save(self, c: dict) -> None:
        self.root.write("catalog.json", c)

    def create(self, name: str, dimension: int, metric: str = "cosine", bm25_enabled: bool | None = None, deletion_protected: bool = False, tags: dict | None = None, embedder: dict | None = None) -> dict:
        check_name(name)
        if isinstance(dimension, bool) or not isinstance(dimension, int) or not 1 <= dimension <= 20_000:
            raise invalid("dimension must be between 1 and 20000")
        check_metric(metric)
        c = self._load()
        if name in c["collections"]:
            raise EngineError("COLLECTION_ALREADY_EXISTS", f"collection {name!r} already exists")
        now = _now()
        c["collections"][name] = {
            "id": str(uuid.uuid4()), "name": name, "dimension": dimension, "metric": metric, "bm25Enabled": True if bm25_enabled is None else bm25_enabled, "status": "ready",
            "deletionProtected": deletion_protected, "tags": tags, "embedder": embedder, "createdAt": now, "updatedAt": now, "namespaces": [],
        }
        self._save(c)
        return c["collections"][name]

    def all(self) -> list[dict]:
        return sorted(self._load()["collections"].values(), key=lambda x: x["createdAt"])

    def get(self, name: str) -> dict:
        """By its own name."""
        found = self._load()["collections"].get(name)
        if found is None:
            raise EngineError("COLLECTION_NOT_FOUND", f"collection {name!r} not found")
        return found

    def update(self, name: str, **changes) -> dict:
        c = self._load()
        if name not in c["collections"]:
            raise EngineError("COLLECTION_NOT_FOUND", f"collection {name!r} not found")
        c["collections"][name] |= {k: v for k, v in changes.items() if v is not None} | {"updatedAt": _now()}
        self._save(c)
        return c["collections"][name]

    def begin_drop(self, name: str) -> dict:
        """The collection, which nothing resolves any more."""
        if self.get(name)["deletionProtected"]:
            raise EngineError("PERMISSION_DENIED", f"collection {name!r} is protected")
        return self.update(name, status="deleting")

    def drop(self, name: str) -> None:
        c = self._load()
        del c["collections"][name]
        self._save(c)

    def resolve(self, name: str) -> dict:
        """By name, else by alias; it must be ready.  An alias of an alias leads nowhere."""
        c = self._load()
        found = c["collections"].get(name) or c["collections"].get(c["aliases"].get(name, {}).get("collectionName"))
        if found is None:
            raise EngineError("COLLECTION_NOT_FOUND", f"collection {name!r} not found")
        if found["status"] != "ready":
            raise EngineError("INDEX_NOT_READY", f"collection {name!r} is {found['status']}")
        return found

    def set_alias(self, alias: str, target: str) -> dict:
        """Create or re-point."""
        check_name(alias)
        self.resolve(target)
        c = self._load()
        old = c["aliases"].get(alias, {"createdAt": _now()})
        c["aliases"][alias] = {"alias": alias, "collectionName": target, "createdAt": old["createdAt"], "updatedAt": _now()}
        self._save(c)
        return c["aliases"][alias]

    def aliases(self) -> list[dict]:
        return sorted(self._load()["aliases"].values(), key=lambda x: x["createdAt"])

    def get_alias(self, alias: str) -> dict:
        found = self._load()["aliases"].get(alias)
        if found is None:
            raise EngineError("NOT_FOUND", f"alias {alias!r} not found")
        return found

    def drop_alias(self, alias: str) -> None:
        self.get_alias(alias)
        c = self._load()
        del c["aliases"][alias]
        self._save(c)
