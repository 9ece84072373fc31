import json
import warnings

import pytest

from stratavec.engine import Engine
from stratavec.errors import EngineError
from stratavec.plugins.rerank import LexicalOverlap


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), LexicalOverlap())
    e.create_collection({"name": "c", "dimension": 3})
    rows = [("n1", [0.9, 0.1, 0], {"doc": "news", "k": 1}, "an amber kite glides"), ("n2", [0.8, 0.2, 0], {"doc": "news", "k": 2}, "amber kite"), ("n3", [0.7, 0.3, 0], {"doc": "news"}, None), ("s1", [0.6, 0.4, 0], {"doc": "sports"}, "wet stones"), ("s2", [0.5, 0.5, 0], {"doc": "sports"}, None)]
    e.upsert("c", {"records": [{"id": i, "values": v, "metadata": m, "text": t} for i, v, m, t in rows]})
    e.upsert("c", {"records": [{"id": "n1", "values": [0, 0, 1]}], "namespace": "other"})
    return e


def fails(code, f, *args):
    with pytest.raises(EngineError) as e:
        f(*args)
    assert e.value.code == code, e.value.message


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_query(engine):
    assert ids(engine.query("c", {"vector": [1, 0, 0], "topK": 2})) == ["n1", "n2"]
    assert ids(engine.query("c", {"id": "s2", "topK": 1})) == ["s2"]
    assert ids(engine.query("c", {"vector": [1, 0, 0], "topK": 5, "namespace": "other"})) == ["n1"]
    assert ids(engine.query("c", {"vector": [1, 0, 0], "topK": 5, "namespace": "nowhere"})) == []
    assert ids(engine.query("c", {"vector": [1, 0, 0], "topK": 9, "filter": {"doc": {"$eq": "sports"}}})) == ["s1", "s2"]
    row = engine.query("c", {"vector": [1, 0, 0], "topK": 1, "includeValues": True, "includeMetadata": True}).first()
    assert row["values"] == pytest.approx([0.9, 0.1, 0]) and json.loads(row.metadata)["doc"] == "news"
    assert engine.query("c", {"vector": [1, 0, 0], "topK": 1}).columns == ["rank", "id", "score"]


def test_query_errors(engine):
    fails("COLLECTION_NOT_FOUND", engine.query, "none", {"vector": [1, 0, 0], "topK": 1})
    fails("DIMENSION_MISMATCH", engine.query, "c", {"vector": [1, 0], "topK": 1})
    fails("INVALID_ARGUMENT", engine.query, "c", {"vector": [1, 0, 0], "topK": 0})
    fails("INVALID_ARGUMENT", engine.query, "c", {"topK": 1})
    fails("INVALID_ARGUMENT", engine.query, "c", {"vector": [1, 0, 0], "topK": 1, "scoreThreshold": 1.5})
    fails("VALUES_AND_TEXT_CONFLICT", engine.query, "c", {"vector": [1, 0, 0], "id": "n1", "topK": 1})
    fails("NOT_FOUND", engine.query, "c", {"id": "zz", "topK": 1})
    fails("EMBEDDER_CONFIG", engine.query, "c", {"text": "x", "topK": 1})
    fails("GROUPBY_FIELD_MISSING", engine.query, "c", {"vector": [1, 0, 0], "topK": 3, "groupBy": {"field": "absent"}})
    fails("FILTER_UNSUPPORTED_OPERATOR", engine.query, "c", {"vector": [1, 0, 0], "topK": 3, "filter": {"a": {"$x": 1}}})


def test_groups_and_stages(engine):
    out = engine.search("c", {"vector": [1, 0, 0], "topK": 5, "groupBy": {"field": "doc", "groupSize": 2}}).orderBy("group_rank", "member_rank").collect()
    assert [(r.key, r.id) for r in out] == [("news", "n1"), ("news", "n2"), ("sports", "s1"), ("sports", "s2")]
    assert ids(engine.search("c", {"vector": [1, 0, 0], "topK": 5, "dedup": {"by": "doc"}})) == ["n1", "s1"]
    assert ids(engine.search("c", {"vector": [1, 0, 0], "topK": 5, "scoreThreshold": 0.99})) == ["n1"]
    assert ids(engine.query("c", {"vector": [1, 0, 0], "topK": 2, "rerank": {"query": "sports", "rankField": "doc"}})) == ["s1", "s2"]


def test_hybrid_and_explain(engine):
    assert set(ids(engine.query_hybrid("c", {"vector": [0, 1, 0], "text": "amber kite", "topK": 5}))) >= {"n1", "n2"}
    assert ids(engine.search("c", {"vector": [1, 0, 0], "text": "stones", "topK": 1, "hybrid": {"alpha": 0.0}})) == ["s1"]
    plan = engine.search("c", {"vector": [1, 0, 0], "topK": 3, "scoreThreshold": 0.5, "rerank": {"query": "q"}}, explain=True)["plan"]
    assert plan["source"]["kind"] == "dense" and [s["kind"] for s in plan["stages"]] == ["rerank", "scoreThreshold"] and plan["retrieveK"] == 15
    fails("INVALID_ARGUMENT", engine.search, "c", {"id": "n1", "hybrid": True, "topK": 1})
    fails("INVALID_ARGUMENT", engine.query_hybrid, "c", {"text": "x", "topK": 1})
    engine.create_collection({"name": "plain", "dimension": 3, "bm25Enabled": False})
    fails("HYBRID_REQUIRES_BM25", engine.query_hybrid, "plain", {"vector": [1, 0, 0], "text": "x", "topK": 1})


def test_batch_and_recommend(engine):
    out = engine.query_batch("c", {"queries": [{"id": "s2", "topK": 1}, {"id": "n1", "topK": 1}]})
    assert [ids(x) for x in out] == [["s2"], ["n1"]]
    fails("INVALID_ARGUMENT", engine.query_batch, "c", {"queries": []})
    fails("INVALID_ARGUMENT", engine.query_batch, "c", {"queries": [{}] * 11})
    assert ids(engine.recommend("c", {"positiveIds": ["n1"], "topK": 2})) == ["n2", "n3"]
    assert "n1" not in ids(engine.recommend("c", {"positiveIds": ["n1"], "negativeIds": ["s2", "gone"], "topK": 9}))
    fails("NOT_FOUND", engine.recommend, "c", {"positiveIds": ["gone"], "topK": 2})
    fails("INVALID_ARGUMENT", engine.recommend, "c", {"positiveIds": [], "topK": 2})


def test_writes(engine):
    engine.create_collection({"name": "w", "dimension": 3})
    v = [0.1, 0.2, 0.3]
    batch = [("r1", {"v": "first"}, [1, 1, 1]), ("r2", {"v": "r2"}, v), ("r1", {"v": "second"}, v), ("r3", {"v": "r3", "keep": "no"}, v), ("r1", {"v": "last", "n": 1.50}, v)]
    assert engine.upsert("w", {"records": [{"id": i, "metadata": m, "values": x} for i, m, x in batch]}) == {"upsertedCount": 3}
    got = {r.id: r for r in engine.fetch("w", {"ids": ["r1", "r2", "r9"]}).collect()}
    assert set(got) == {"r1", "r2"} and json.loads(got["r1"].metadata)["v"] == "last" and got["r1"]["values"] == pytest.approx(v)
    engine.update("w", {"id": "r1", "setMetadata": {"b": 2, "v": None}})
    assert json.loads(engine.fetch("w", {"ids": ["r1"]}).first().metadata) == {"v": None, "n": 1.5, "b": 2}
    fails("NOT_FOUND", engine.update, "w", {"id": "r9"})
    engine.upsert("w", {"records": [{"id": "r1", "values": v}]})
    assert engine.fetch("w", {"ids": ["r1"]}).first().metadata is None  # replaced wholesale
    engine.delete("w", {"filter": {"keep": {"$eq": "no"}}})
    assert engine.list("w")[0] == ["r1", "r2"]
    engine.vacuum("w")
    engine.delete("w", {"ids": ["r2"]})
    assert engine.list("w") == (["r1"], None)
    engine.upsert("w", {"records": [{"id": "r2", "values": v}], "namespace": "x"})
    assert engine.namespaces("w") == ["", "x"] and engine.describe_namespace("w", "x")["recordCount"] == 1
    assert engine.create_namespace("w", "y") == {"name": "y", "recordCount": 0} and engine.namespaces("w") == ["", "x", "y"]
    assert {r.namespace: r.record_count for r in engine.stats("w").collect()} == {"": 1, "x": 1}
    engine.delete_namespace("w", "x")
    engine.delete("w", {"deleteAll": True})
    assert engine.list("w")[0] == []
    fails("INVALID_ARGUMENT", engine.delete, "w", {})


def test_write_errors(engine):
    assert engine.upsert("c", {"records": []}) == {"upsertedCount": 0}
    fails("DIMENSION_MISMATCH", engine.upsert, "c", {"records": [{"id": "x", "values": [1]}]})
    fails("SPARSE_NOT_SUPPORTED", engine.upsert, "c", {"records": [{"id": "x", "values": [1, 2, 3], "sparseValues": {}}]})
    fails("INVALID_ARGUMENT", engine.upsert, "c", {"records": [{"id": "x"}] * 1001})
    fails("INVALID_ARGUMENT", engine.upsert, "c", {"records": [{"id": "é" * 257, "values": [1, 2, 3]}]})


def test_pages(engine):
    engine.create_collection({"name": "p", "dimension": 1})
    engine.upsert("p", {"records": [{"id": f"v{i}", "values": [1], "metadata": {"s": i % 2}} for i in range(5)]})
    pages, cursor = [], None
    while True:
        page, cursor = engine.scroll("p", {"limit": 2, "cursor": cursor})
        pages.append([r.id for r in page.collect()])
        if cursor is None:
            break
    assert pages == [["v0", "v1"], ["v2", "v3"], ["v4"]]
    assert engine.list("p", limit=2) == (["v0", "v1"], "v1") and engine.list("p", token="v3") == (["v4"], None)
    assert engine.scroll("p", {"filter": {"s": {"$eq": 1}}})[0].count() == 2
    assert engine.sample("p", {"size": 3}).count() == 3
    assert engine.fetch_by_metadata("p", {"filter": {"s": {"$eq": 1}}, "limit": 1}).first().id == "v1"
    assert [r["count"] for r in engine.facets("p", {"field": "s"}).collect()] == [3, 2]
    assert engine.total("p") == {"totalRecordCount": 5, "namespaces": {"": 5}, "dimension": 1}


def test_indexes_are_read_while_they_are_fresh(engine):
    ask = {"vector": [1, 0, 0], "text": "amber", "topK": 3}
    plain = {k: [tuple(r) for r in engine.query_hybrid("c", {**ask, **more}).orderBy("rank").collect()] for k, more in enumerate(({}, {"filter": {"k": {"$gte": 2}}}))}
    near = ids(engine.query("c", {"vector": [1, 0, 0], "topK": 3}))
    engine.reindex("c", 2)

    def files(df):
        return " ".join(df.inputFiles())

    for k, more in enumerate(({}, {"filter": {"k": {"$gte": 2}}})):
        found = engine.query_hybrid("c", {**ask, **more})
        assert [tuple(r) for r in found.orderBy("rank").collect()] == plain[k] and "/postings-" in files(found)
        assert "In(term, [amber])" in found._jdf.queryExecution().toString() or "EqualTo(term,amber)" in found._jdf.queryExecution().toString()
    found = engine.query("c", {"vector": [1, 0, 0], "topK": 3})
    assert ids(found) == near and "/nearest-" in files(found)
    assert "/nearest-" not in files(engine.query("c", {"vector": [1, 0, 0], "topK": 3, "filter": {"k": {"$gte": 1}}}))
    engine.upsert("c", {"records": [{"id": "n1", "values": [0, 0, 1]}], "namespace": "other"})
    assert "/nearest-" not in files(engine.query("c", {"vector": [1, 0, 0], "topK": 3})) and "/postings-" not in files(engine.query_hybrid("c", ask))


def test_control(engine):
    for bad in ({"name": "Bad Name", "dimension": 3}, {"name": "-a", "dimension": 3}, {"name": "a" * 46, "dimension": 3}, {"name": "a", "dimension": 0}, {"name": "a", "dimension": 3, "metric": "hamming"}):
        fails("INVALID_ARGUMENT", engine.create_collection, bad)
    fails("COLLECTION_ALREADY_EXISTS", engine.create_collection, {"name": "c", "dimension": 3})
    engine.create_collection({"name": "kept", "dimension": 3, "deletionProtected": True})
    fails("PERMISSION_DENIED", engine.delete_collection, "kept")
    engine.configure("kept", {"deletionProtected": False, "bm25Enabled": True, "tags": {"a": 1}})
    assert engine.describe("kept")["tags"] == {"a": 1} and engine.describe("kept")["status"]["ready"]
    engine.catalog.set_alias("nick", "kept")
    assert engine.catalog.resolve("nick")["name"] == "kept"
    engine.catalog.set_alias("nick", "c")
    assert ids(engine.query("nick", {"vector": [1, 0, 0], "topK": 1})) == ["n1"]
    engine.catalog.set_alias("nick2", "nick")
    fails("COLLECTION_NOT_FOUND", engine.catalog.resolve, "nick2")
    fails("COLLECTION_NOT_FOUND", engine.catalog.set_alias, "x", "nowhere")
    fails("NOT_FOUND", engine.catalog.get_alias, "none")
    engine.catalog.drop_alias("nick")
    engine.catalog.update("kept", status="initializing")
    fails("INDEX_NOT_READY", engine.query, "kept", {"vector": [1, 0, 0], "topK": 1})
    assert {c["name"]: c["status"]["state"] for c in engine.collections()}["kept"] == "Initializing"
    engine.catalog.begin_drop("kept")
    assert {c["name"]: c["status"]["state"] for c in engine.collections()}["kept"] == "Terminating"
    fails("INDEX_NOT_READY", engine.query, "kept", {"vector": [1, 0, 0], "topK": 1})
    engine.delete_collection("kept")
    fails("COLLECTION_NOT_FOUND", engine.describe, "kept")
    assert "c" in [c["name"] for c in engine.catalog.all()] and [a["alias"] for a in engine.catalog.aliases()] == ["nick2"]


def test_embedded_collection(engine):
    config = {"backend": "hash-projection", "model": "16"}
    fails("EMBEDDER_DIMENSION_MISMATCH", engine.create_collection, {"name": "e", "dimension": 3, "embedder": config})
    fails("EMBEDDER_CONFIG", engine.create_collection, {"name": "e", "dimension": 3, "embedder": {"backend": "x", "model": "y"}})
    engine.create_collection({"name": "e", "dimension": 16, "embedder": config, "bm25Enabled": False})
    engine.upsert("e", {"records": [{"id": "a", "text": "red kite"}, {"id": "b", "text": "blue whale"}]})
    fails("TEXT_REQUIRED", engine.upsert, "e", {"records": [{"id": "a"}]})
    fails("VALUES_AND_TEXT_CONFLICT", engine.upsert, "e", {"records": [{"id": "a", "text": "x", "values": [0.0] * 16}]})
    assert ids(engine.search("e", {"text": "a kite", "topK": 1})) == ["a"]
    kept = dict(engine.cache.kept)
    engine.search("e", {"text": "a kite", "topK": 1})
    assert engine.cache.kept == kept
    engine.search("e", {"text": "a kite", "topK": 1, "noCache": True})
    assert engine.cache.kept != kept


def test_unknown_reranker_is_a_noop():
    from stratavec.plugins.rerank import Noop, build_reranker

    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert isinstance(build_reranker("what"), Noop) and seen
