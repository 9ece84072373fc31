import pytest

from stratavec.errors import STATUS, EngineError
from stratavec.functions.jsonpath import merge_objects, split_object
from stratavec.plans.compiler import Compiler, retrieve_k
from stratavec.plugins.embed import EmbedderFactory, HashProjection, QueryCache, embed_all, embed_column
from stratavec.plugins.http import send_with_retry
from stratavec.plugins.rerank import CrossEncoder, HttpReranker, build_reranker


def test_over_fetch():
    most = 2**63
    assert retrieve_k(10, False, False, False, most) == 10
    assert retrieve_k(10, True, False, False, most) == 50
    assert retrieve_k(10, False, True, False, most) == 50
    assert retrieve_k(10, True, True, False, most) == 250
    assert retrieve_k(10, False, False, True, most) == 20
    assert retrieve_k(10, True, False, True, most) == 50
    assert retrieve_k(200, True, False, False, 100) == 100
    assert retrieve_k(9000, True, True, True, most) == 10_000


def test_search_chooses_its_source():
    c = Compiler(2, True, lambda i, n: [1.0, 0.0], lambda t, fresh=False: [0.0, 1.0], 1000)
    assert c.search({"text": "x", "topK": 3}).source.kind == "hybrid"
    assert c.search({"text": "x", "topK": 3, "hybrid": False}).source.kind == "dense"
    p = c.search({"vector": [1, 0], "text": "x", "topK": 3, "hybrid": {"alpha": 0.2, "bm25Weight": 0.9}})
    assert (p.source.alpha, p.source.bm25_weight, p.retrieve_k) == (0.2, 0.9, 3)
    assert c.search({"vector": [1, 0], "text": "x", "topK": 3, "hybrid": {}}).source.kind == "hybrid"
    p = c.search({"id": "a", "topK": 3, "dedup": {"by": "u"}, "groupBy": {"field": "g"}})
    assert [s.kind for s in p.stages] == ["dedup", "groupBy"] and p.retrieve_k == 15
    assert c.search({"id": "a", "topK": 3, "dedup": {"by": "u"}}).stages[-1].args == {"k": 3}
    for bad in ({"topK": 3, "dedup": {"by": ""}, "id": "a"}, {"topK": 3, "groupBy": {"field": "g", "limit": 101}, "id": "a"}, {"topK": 3, "groupBy": {"field": ""}, "id": "a"}, {"topK": 10_001, "id": "a"}):
        with pytest.raises(EngineError):
            c.search(bad)


def test_retry():
    answers, slept = [(429, {}), (429, {}), (200, {"ok": 1})], []
    assert send_with_retry(lambda *a: answers.pop(0), "u", {}, {}, 3, "EMBEDDER", slept.append) == {"ok": 1} and slept == [1.0, 2.0]
    for answer, code in ((429, "EMBEDDER_RATE_LIMITED"), (500, "EMBEDDER_UPSTREAM")):
        with pytest.raises(EngineError) as e:
            send_with_retry(lambda *a, s=answer: (s, {}), "u", {}, {}, 1, "EMBEDDER", lambda s: None)
        assert e.value.code == code

    def late(*a):
        raise TimeoutError("late")

    with pytest.raises(EngineError) as e:
        send_with_retry(late, "u", {}, {}, 1, "RERANKER")
    assert e.value.code == "RERANKER_TIMEOUT" and e.value.status == STATUS["RERANKER_TIMEOUT"] == 504


def test_http_rerankers():
    seen = {}

    def fake(url, headers, body):
        seen.update(url=url, headers=headers, body=body)
        return 200, {"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.1}], "data": [{"index": 0, "score": 0.7, "relevance_score": 0.6}]}

    r = build_reranker("cohere", key="k", transport=fake)
    assert r.scores("q", ["a", "b"], [0, 0], "m") == [0.1, 0.9] and seen["body"]["model"] == "m" and r.max_candidates == 1000
    r = HttpReranker("pinecone", "k", transport=fake)
    assert r.scores("q", ["a"], [0]) == [0.7] and r.max_candidates == 100 and seen["headers"] == {"Api-Key": "k"}
    assert HttpReranker("voyage", "k", transport=fake).scores("q", ["a"], [0]) == [0.6] and seen["body"]["top_k"] == 1
    assert CrossEncoder("http://h/", transport=lambda *a: (200, [{"index": 0, "score": -3.2}])).scores("q", ["a"], [0]) == [-3.2]
    assert r.scores("q", [], []) == []
    with pytest.raises(EngineError):
        build_reranker("jina", key="")


def test_embedders(spark):
    calls = []

    class Counting(HashProjection):
        max_batch = 2

        def embed(self, texts, kind="document"):
            calls.append(len(texts))
            return super().embed(texts, kind)

    e = Counting("4")
    assert embed_all(e, ["a", "b", "c", "d", "e"]) == HashProjection("4").embed(["a", "b", "c", "d", "e"]) and calls == [2, 2, 1]
    df = spark.createDataFrame([("x",), (None,), ("",)], "t string").select(embed_column(HashProjection("4"))("t").alias("v"))
    got = [r.v for r in df.collect()]
    assert len(got[0]) == 4 and got[1] is None and got[2] == [0.0] * 4
    fake = lambda url, h, body: (200, {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}], "embeddings": {"float": [[3.0]]}})
    f = EmbedderFactory({"openai": "k", "cohere": "k"}, transport=fake)
    assert f.get({"backend": "openai", "model": "m"}).embed(["a", "b"]) == [[1.0], [2.0]]
    assert f.get({"backend": "cohere", "model": "m"}).embed(["a"], "query") == [[3.0]]
    assert f.get({"backend": "openai", "model": "m"}) is f.get({"backend": "openai", "model": "m"})
    for bad in ("voyage", "tei", "none"):
        with pytest.raises(EngineError):
            f.get({"backend": bad, "model": "m"})


def test_query_cache():
    now, e = [0.0], HashProjection("4")
    made = []
    e.embed = lambda texts, kind="document": made.append(texts) or [[1.0]]
    cache = QueryCache(capacity=1, ttl=60, clock=lambda: now[0])
    cache.get(e, " hi ")
    cache.get(e, "hi")
    assert len(made) == 1
    now[0] = 61
    cache.get(e, "hi")
    cache.get(e, "other")
    cache.get(e, "hi")
    cache.get(e, "hi", fresh=True)
    assert len(made) == 5


def test_merge_keeps_numbers_as_written():
    assert merge_objects('{"a": 1.50, "b":[1, 2]}', '{"b":5e1,"c":null}') == '{"a":1.50,"b":5e1,"c":null}'
    assert merge_objects(None, '{"a":1}') == '{"a":1}' and merge_objects('{"a":1}', None) == '{"a":1}' and merge_objects(None, None) is None
    assert merge_objects("[1]", '{"a":1}') == '{"a":1}'
    assert split_object('{"k": {"x": "}"} , "é": "\\u00e9"}') == {"k": '{"x": "}"}', "é": '"\\u00e9"'} and split_object("{}") == {} and split_object("{") is None
