import pytest

from stratavec.errors import EngineError
from stratavec.operators import browse, writes
from stratavec.sources import records as rec


@pytest.fixture(scope="module")
def rows(records):
    category = {"r1": "Electronics", "r2": "Electronics", "r3": "Books", "r4": "Electronics", "r5": "Books"}
    return records(*[(k, [1.0, float(i)], f'{{"category":"{v}","o":{{"x":{i}}}}}') for i, (k, v) in enumerate(category.items())], ("r6", None, None), ("r7", None, '{"other":1}')).cache()


def test_facets(rows):
    assert [tuple(r) for r in browse.facets(rows, "category").collect()] == [("Electronics", 3), ("Books", 2)]
    assert [r["count"] for r in browse.facets(rows, "o.x", 2).collect()] == [1, 1]
    for bad in ("bad field", "a'b;--", "123", "", "a" * 101):
        with pytest.raises(EngineError):
            browse.facets(rows, bad)
    with pytest.raises(EngineError):
        browse.facets(rows, "category", 101)


def test_pages(records):
    rows = records(*[(i, None) for i in ("doc-1", "doc-2", "img-1", "doc_3", "doc%4")])
    assert [r.id for r in browse.list_ids(rows, "doc-").collect()] == ["doc-1", "doc-2"]
    assert [r.id for r in browse.list_ids(rows, "doc_").collect()] == ["doc_3"]
    assert [r.id for r in browse.list_ids(rows, "", "doc-1", 2).collect()] == ["doc-2", "doc_3"]
    assert len(browse.scroll(rows, None, 2).collect()) == 3
    assert browse.first_by_id(rows, 0).count() == 0


def test_fetch_and_sample(spark, rows):
    assert sorted(r.id for r in browse.fetch(rows, ["r1", "none", "r3"]).collect()) == ["r1", "r3"]
    assert browse.fetch(rows, []).count() == 0
    with pytest.raises(EngineError):
        browse.fetch(rows, ["x"] * 1001)
    assert browse.fetch_in(rows, spark.createDataFrame([("r1",), ("r1",), (None,)], "id string")).count() == 1
    assert browse.sample(rows, 3, seed=1).count() == 3 and browse.sample(rows, 50).count() == 7 and browse.sample(rows, 0).count() == 1
    assert browse.sample(rows, 3, seed=1).select("id").collect() == browse.sample(rows, 3, seed=1).select("id").collect()


def test_vectors(rows):
    assert browse.mean_vector(rows).first()[0] == [1.0, 2.0]
    assert browse.recommend_vector(rows, ["r1", "r5"], ["r3", "none"]).first()[0] == pytest.approx([0.5, 1.0])
    assert browse.recommend_vector(rows, ["r2", "r2", "r5"]).first()[0] == pytest.approx([1.0, 2.0])


def test_parse_vector(spark):
    df = spark.createDataFrame([("[1,2.5, 3 ]",), ("[]",), ("[1,x,2]",), (None,)], "s string").select(rec.parse_vector("s").alias("v"))
    assert [r.v for r in df.collect()] == [[1.0, 2.5, 3.0], [], [1.0, 2.0], None]


def test_writes(spark):
    log = spark.createDataFrame(
        [(1, "c", "a", None, "upsert", "2024-01-02", "2024-01-02"), (1, "c", "a", None, "upsert", "2024-01-02", "2024-01-05"), (2, "c", "a", "", "update", "2024-01-03", "2024-01-09"), (3, "c", "b", "n", "delete", "2024-01-01", "2024-01-01"), (4, "c", "b", "n", "upsert", None, None)],
        "write_id long, collection_name string, id string, namespace string, op string, requested_at string, received_at string",
    )
    assert sorted((r.id, r.namespace, r.write_id) for r in writes.replay(log).collect()) == [("a", "", 2), ("b", "n", 3)]
    assert writes.replay(log.limit(0)).count() == 0


def test_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id":"a","values":[1,2],"metadata":{"n":5.0}}\n{"id":"b","text":"t","namespace":"x"}\n')
    rows = {r.id: r for r in rec.from_json_lines(spark, str(tmp_path)).collect()}
    assert rows["a"].metadata == '{"n":5.0}' and rows["a"].namespace == "" and rows["b"].namespace == "x" and rows["b"]["values"] is None
