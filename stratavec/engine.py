"""The service's operations over a folder of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.errors import EngineError, invalid
from stratavec.operators import ann, browse, retrieval, writes
from stratavec.operators.filters import apply_filter, predicate
from stratavec.plans.ast import Plan
from stratavec.plans.compiler import Compiler
from stratavec.plans.lower import lower
from stratavec.plugins.embed import EmbedderFactory, QueryCache, embed_all
from stratavec.plugins.rerank import Noop, Reranker
from stratavec.sources.catalog import Catalog
from stratavec.sources.files import Folder
from stratavec.sources.store import RecordStore

MOST_RECORDS = 1000


class Engine:
    """Requests are dicts by the wire format's names; answers are DataFrames, or dicts where they are small."""

    def __init__(self, spark: SparkSession, root: str, reranker: Reranker | None = None, embedders: EmbedderFactory | None = None):
        self.spark, self.root = spark, Folder(root)
        self.catalog = Catalog(self.root)
        self.reranker, self.embedders, self.cache = reranker or Noop(), embedders or EmbedderFactory(), QueryCache()

    # ------------------------------------------------------------ collections

    def create_collection(self, request: dict) -> dict:
        if embedder := request.get("embedder"):
            got = len(embed_all(self.embedders.get(embedder), ["x"])[0])
            if got != request.get("dimension"):
                raise EngineError("EMBEDDER_DIMENSION_MISMATCH", f"the embedder gives {got} numbers", expected=request.get("dimension"), got=got)
        return self.catalog.create(request.get("name"), request.get("dimension"), request.get("metric", "cosine"), request.get("bm25Enabled"), request.get("deletionProtected", False), request.get("tags"), embedder)

    def configure(self, name: str, request: dict) -> dict:
        new = self.catalog.update(name, deletionProtected=request.get("deletionProtected"), tags=request.get("tags"), bm25Enabled=request.get("bm25Enabled"))
        if request.get("bm25Enabled"):
            self.rebuild_postings(name)
        elif request.get("bm25Enabled") is False:
            self._drop_indexes(new, "postings")
        return new

    def delete_collection(self, name: str) -> None:
        c = self.catalog.begin_drop(name)  # ``deleting`` until its data is gone
        self._store(c).drop()
        self.catalog.drop(name)

    def describe(self, name: str) -> dict:
        c = self.catalog.get(name)
        return _described(c)

    def collections(self) -> list[dict]:
        """All collections with their states, in the order they were made."""
        return [_described(c) for c in self.catalog.all()]

    def stats(self, name: str) -> DataFrame:
        return browse.namespace_counts(self._store(self.catalog.get(name)).read())

    def total(self, name: str) -> dict:
        """Counts of the collection and of its namespaces."""
        counts = {r.namespace: r.record_count for r in self.stats(name).collect()}  # a row a namespace
        return {"totalRecordCount": sum(counts.values()), "namespaces": counts, "dimension": self.catalog.get(name)["dimension"]}

    def vacuum(self, name: str) -> None:
        self._store(self.catalog.get(name)).compact()

    def reindex(self, name: str, cells: int | None = None) -> dict:
        """Builds and keeps the inverted file, and the keyword index where there is one, of the current version."""
        c = self.catalog.get(name)
        index = ann.build(self._store(c).read(), c["metric"], c["dimension"], cells)
        index.write(self._index_folder(c, "nearest"))
        if c["bm25Enabled"]:
            self.rebuild_postings(name)
        return {"collection": c["name"], "cells": len(index.centroids), "visitedShare": index.share}

    def rebuild_postings(self, name: str) -> str:
        """The keyword index of the current version, written by term; its folder."""
        c = self.catalog.get(name)
        at = self._index_folder(c, "postings")
        retrieval.write_postings(self._store(c).read(), at)
        return at

    def _index_folder(self, c: dict, kind: str) -> str:
        return f"{self.root.uri}/{c['id']}/{kind}-{self._store(c).manifest()['version']}"

    def _fresh(self, c: dict, kind: str, last: str) -> str | None:
        """The folder of an index of the current version, if it was written to the end."""
        at = self._index_folder(c, kind)
        return at if Folder(f"{at}/{last}").names("_SUCCESS") else None

    def _drop_indexes(self, c: dict, kind: str) -> None:
        folder = self.root.sub(c["id"])
        for name in folder.names(f"{kind}-"):
            folder.sub(name).delete()

    def _store(self, c: dict) -> RecordStore:
        return RecordStore(self.spark, self.root.sub(c["id"]))

    def _records(self, name: str, request: dict) -> tuple[dict, DataFrame]:
        """The collection and the rows of the request's namespace and filter."""
        c = self.catalog.resolve(name)
        rows = self._store(c).read().where(F.col("namespace") == (request.get("namespace") or ""))
        return c, apply_filter(rows, request.get("filter"))

    # ------------------------------------------------------------ writes

    def upsert(self, name: str, request: dict) -> dict:
        records, namespace = request.get("records") or [], request.get("namespace") or ""
        if not records:
            return {"upsertedCount": 0}
        if len(records) > MOST_RECORDS:
            raise invalid(f"at most {MOST_RECORDS} records")
        c = self.catalog.resolve(name)
        last: dict[str, dict] = {}
        for r in records:
            if len((r.get("id") or "").encode()) > 512 or not r.get("id"):
                raise invalid("an id has 1 to 512 bytes")
            if r.get("sparseValues") is not None:
                raise EngineError("SPARSE_NOT_SUPPORTED", "sparse vectors aren't supported", recordId=r["id"])
            if r.get("values") is not None and r.get("text") is not None and c["embedder"]:
                raise EngineError("VALUES_AND_TEXT_CONFLICT", "a collection with an embedder takes values or text of a record, not both", recordId=r["id"])
            if r.get("values") is None and (r.get("text") is None or not c["embedder"]):
                raise EngineError("TEXT_REQUIRED" if c["embedder"] else "INVALID_ARGUMENT", "a record needs values, or text where the collection has an embedder", recordId=r["id"])
            if r.get("values") is not None and len(r["values"]) != c["dimension"]:
                raise EngineError("DIMENSION_MISMATCH", "wrong number of values", expected=c["dimension"], got=len(r["values"]), recordId=r["id"])
            last.pop(r["id"], None)
            last[r["id"]] = r
        rows = list(last.values())
        open_ = [r for r in rows if r.get("values") is None]
        if open_:
            vectors = embed_all(self.embedders.get(c["embedder"]), [r["text"] for r in open_])
            for r, v in zip(open_, vectors):
                if len(v) != c["dimension"]:
                    raise EngineError("EMBEDDER_DIMENSION_MISMATCH", "the embedder gives another dimension", expected=c["dimension"], got=len(v))
            found = {r["id"]: v for r, v in zip(open_, vectors)}
            rows = [{**r, "values": found.get(r["id"], r.get("values"))} for r in rows]
        from stratavec.functions.jsonpath import json_text

        data = [(r["id"], namespace, [float(x) for x in r["values"]], r.get("text"), None if r.get("metadata") is None else json_text(r["metadata"])) for r in rows]
        self._write(c, self.spark.createDataFrame(data, "id string, namespace string, values array<float>, text_content string, metadata string"))
        return {"upsertedCount": len(rows)}

    def _write(self, c: dict, batch: DataFrame) -> None:
        store = self._store(c)
        store.put(writes.upserted(store.read(), batch))

    def bulk_upsert(self, name: str, rows: DataFrame, order: str = "seq") -> None:
        """A table of any size (id, namespace, values, text_content, metadata, <order>); wrong dimensions are an error."""
        c = self.catalog.resolve(name)
        bad = rows.where(F.col("values").isNull() | (F.size("values") != c["dimension"])).select("id").head()
        if bad:
            raise EngineError("DIMENSION_MISMATCH", "wrong number of values", expected=c["dimension"], recordId=bad.id)
        self._write(c, writes.last_wins(rows, order))

    def update(self, name: str, request: dict) -> dict:
        from stratavec.functions.jsonpath import json_text

        c, namespace = self.catalog.resolve(name), request.get("namespace") or ""
        store = self._store(c)
        change = (namespace, request["id"], request.get("values"), request.get("text"), None if request.get("setMetadata") is None else json_text(request["setMetadata"]))
        changes = self.spark.createDataFrame([change], "namespace string, id string, values array<float>, text_content string, set_metadata string")
        new = writes.updated(store.read(), changes).persist()
        try:
            if new.isEmpty():
                raise EngineError("NOT_FOUND", f"record {request['id']!r} not found")
            store.put(new)
        finally:
            new.unpersist()
        return {}

    def delete(self, name: str, request: dict) -> dict:
        c = self.catalog.resolve(name)
        store = self._store(c)
        rows = store.read().where(F.col("namespace") == (request.get("namespace") or ""))
        if request.get("deleteAll") is True:
            keys = rows
        elif request.get("ids") is not None:
            keys = browse.fetch(rows, request["ids"])
        elif request.get("filter") is not None:
            keys = rows.where(predicate(request["filter"]))
        else:
            raise invalid("say what to delete: ids, a filter or everything")
        store.remove(keys)
        return {}

    # ------------------------------------------------------------ namespaces

    def create_namespace(self, name: str, namespace: str) -> dict:
        c = self.catalog.resolve(name)
        self.catalog.update(c["name"], namespaces=sorted({*c["namespaces"], namespace}))
        return {"name": namespace, "recordCount": 0}

    def namespaces(self, name: str) -> list[str]:
        c = self.catalog.resolve(name)
        return sorted({*c["namespaces"], *(r.namespace for r in browse.namespaces(self._store(c).read()).toLocalIterator())})

    def describe_namespace(self, name: str, namespace: str) -> dict:
        return {"name": namespace, "recordCount": self._records(name, {"namespace": namespace})[1].count()}

    def delete_namespace(self, name: str, namespace: str) -> None:
        c = self.catalog.resolve(name)
        self.catalog.update(c["name"], namespaces=[n for n in c["namespaces"] if n != namespace])
        self.delete(name, {"namespace": namespace, "deleteAll": True})

    # ------------------------------------------------------------ reads

    def _shown(self, rows: DataFrame, request: dict, metadata: bool) -> DataFrame:
        shown = ["id"] + ["values"] * bool(request.get("includeValues")) + ["metadata"] * metadata
        return rows.select(*shown)

    def fetch(self, name: str, request: dict) -> DataFrame:
        return browse.fetch(self._records(name, request)[1], request.get("ids") or []).select("id", "values", "metadata")

    def fetch_by_metadata(self, name: str, request: dict) -> DataFrame:
        if request.get("filter") is None:
            raise invalid("filter is missing")
        return browse.first_by_id(self._shown(self._records(name, request)[1], request, True), request.get("limit", 100))

    def list(self, name: str, namespace: str = "", prefix: str = "", limit: int = 100, token: str | None = None) -> tuple[list[str], str | None]:
        limit = max(1, min(limit, 1000))
        ids = [r.id for r in browse.list_ids(self._records(name, {"namespace": namespace})[1], prefix, token, limit).collect()]
        return ids, ids[-1] if len(ids) == limit else None

    def scroll(self, name: str, request: dict) -> tuple[DataFrame, str | None]:
        """A page and the cursor of the next one, if there is one."""
        limit = max(1, min(request.get("limit", 100), 1000))
        page = browse.scroll(self._shown(self._records(name, request)[1], request, request.get("includeMetadata", True)), request.get("cursor"), limit)
        ids = [r.id for r in page.select("id").orderBy("id").collect()]  # 1001 at most
        return page.orderBy("id").limit(limit), ids[limit - 1] if len(ids) > limit else None

    def sample(self, name: str, request: dict) -> DataFrame:
        rows = self._records(name, request)[1].select("namespace", "id", "values", "metadata")
        return self._shown(browse.sample(rows, request.get("size", 10), request.get("seed")), request, request.get("includeMetadata", True))

    def facets(self, name: str, request: dict) -> DataFrame:
        return browse.facets(self._records(name, request)[1], request.get("field") or "", request.get("limit", 20))

    # ------------------------------------------------------------ queries

    def _compiler(self, c: dict) -> Compiler:
        def by_id(id_: str, namespace: str) -> list[float]:
            row = self._store(c).read().where((F.col("id") == id_) & (F.col("namespace") == namespace)).select("values").first()
            if row is None:
                raise EngineError("NOT_FOUND", f"record {id_!r} not found")
            return row[0] or []

        def by_text(text: str, fresh: bool) -> list[float]:
            if not c["embedder"]:
                raise EngineError("EMBEDDER_CONFIG", "the collection has no embedder")
            vector = self.cache.get(self.embedders.get(c["embedder"]), text, fresh)
            if len(vector) != c["dimension"]:
                raise EngineError("EMBEDDER_DIMENSION_MISMATCH", "the embedder gives another dimension", expected=c["dimension"], got=len(vector))
            return vector

        return Compiler(c["dimension"], c["bm25Enabled"], by_id, by_text, self.reranker.max_candidates)

    def compile(self, name: str, request: dict, kind: str = "search") -> tuple[dict, Plan]:
        c = self.catalog.resolve(name)
        return c, getattr(self._compiler(c), kind)(request)

    def _run(self, name: str, request: dict, kind: str) -> DataFrame:
        c, plan = self.compile(name, request, kind)
        words = self._fresh(c, "postings", "stats") if plan.source.kind == "hybrid" else None
        near = self._fresh(c, "nearest", "head") if plan.source.kind == "dense" and plan.filter is None else None
        keywords = retrieval.read_postings(self.spark, words) if words else None
        return lower(plan, self._store(c).read(), c["metric"], self.reranker, keywords, ann.read(self.spark, near) if near else None)

    def search(self, name: str, request: dict, explain: bool = False) -> DataFrame | dict:
        return {"plan": self.compile(name, request)[1].explain()} if explain else self._run(name, request, "search")

    def query(self, name: str, request: dict) -> DataFrame:
        return self._run(name, request, "query")

    def query_hybrid(self, name: str, request: dict) -> DataFrame:
        return self._run(name, request, "hybrid")

    def query_batch(self, name: str, request: dict) -> list[DataFrame]:
        """The answers of 1 to 10 queries, in their order."""
        queries = request.get("queries") or []
        if not 1 <= len(queries) <= 10:
            raise invalid("a batch has 1 to 10 queries")
        return [self.query(name, q) for q in queries]

    def recommend(self, name: str, request: dict) -> DataFrame:
        positive, negative = request.get("positiveIds") or [], request.get("negativeIds") or []
        if not positive:
            raise invalid("there is no positive id")
        if len(positive) + len(negative) > 100:
            raise invalid("at most 100 ids")
        top_k = request.get("topK")
        if not isinstance(top_k, int) or not 1 <= top_k <= retrieval.MOST:
            raise invalid(f"topK must be between 1 and {retrieval.MOST}")
        c, rows = self._records(name, {"namespace": request.get("namespace")})
        known = {r.id for r in browse.fetch(rows, positive).select("id").collect()}
        if missing := [i for i in positive if i not in known]:
            raise EngineError("NOT_FOUND", f"record {missing[0]!r} not found")
        vector = browse.recommend_vector(rows, positive, negative).first()[0]
        fetch = min(top_k + len(positive) + len(negative), retrieval.MOST)
        found = retrieval.dense(apply_filter(rows, request.get("filter")), vector, c["metric"], fetch)
        out = recommend_cut(found, [*positive, *negative], top_k, request.get("scoreThreshold"))
        shown = ["rank", "id", "score"] + ["values"] * bool(request.get("includeValues")) + ["metadata"] * bool(request.get("includeMetadata"))
        return out.select(*shown)


def _described(c: dict) -> dict:
    state = {"ready": "Ready", "deleting": "Terminating"}.get(c["status"], "Initializing")
    return {k: v for k, v in c.items() if k not in ("status", "namespaces")} | {"status": {"ready": c["status"] == "ready", "state": state}}


def recommend_cut(found: DataFrame, without: list[str], k: int, least: float | None = None) -> DataFrame:
    """The first k that aren't among the ids asked with; then the threshold."""
    from pyspark.sql import Window

    out = found.where(~F.col("id").isin(without)).withColumn("rank", F.row_number().over(Window.orderBy("rank"))).where(F.col("rank") <= k)
    return out if least is None else out.where(F.col("score") >= least)
