import math

import pytest
from pyspark.sql import functions as F

from stratavec.functions.metrics import arrow_score
from stratavec.operators import ann, retrieval

UNIT = [("v1", [1.0, 0, 0]), ("v2", [0.0, 1, 0]), ("v3", [0.0, 0, 1])]


def top(df):
    return [(r.rank, r.id, None if r.score is None else round(r.score, 4)) for r in df.orderBy("rank").collect()]


def test_metrics(records):
    rows = records(*UNIT)
    assert top(retrieval.dense(rows, [1, 0, 0], "cosine", 3)) == [(1, "v1", 1.0), (2, "v2", 0.0), (3, "v3", 0.0)]
    assert top(retrieval.dense(rows, [1, 0, 0], "euclidean", 2)) == [(1, "v1", 1.0), (2, "v2", round(1 / (1 + math.sqrt(2)), 4))]
    assert top(retrieval.dense(records(("v1", [1.0, 0, 0]), ("v2", [0.5, 0.5, 0])), [1, 0, 0], "dotproduct", 5)) == [(1, "v1", 1.0), (2, "v2", 0.5)]


def test_unusable_vectors_come_last_or_not_at_all(records):
    rows = records(("n", None), ("s", [1.0]), ("z", [0.0, 0, 0]), ("x", [float("nan"), 1, 0]), ("v", [1.0, 1, 0]))
    assert top(retrieval.dense(rows, [1, 0, 0], "cosine", 9)) == [(1, "v", 0.7071), (2, "x", None), (3, "z", None)]
    assert top(retrieval.dense(rows.limit(0), [1, 0, 0], "cosine", 9)) == []


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dotproduct"])
def test_arrow_scores_are_the_same(records, metric):
    rows = records(("n", None), ("s", [1.0]), ("z", [0.0, 0, 0]), ("v", [1.0, 1, 0]), ("w", [0.1, -2.0, 3.0]))
    q = [0.3, 0.2, -0.4]
    assert top(retrieval.dense(rows, q, metric, 9)) == top(retrieval.dense(rows, q, metric, 9, arrow_score(metric, q)("values")))


def test_batch(spark, records):
    queries = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 0.0, 1.0]), ("c", [1.0])], "query_id string, query array<float>")
    out = retrieval.batch(records(*UNIT), queries, "cosine", 1).select("query_id", "id").collect()
    assert sorted((r.query_id, r.id) for r in out) == [("a", "v1"), ("b", "v3")]


TEXTS = [("v1", [1.0, 0, 0], None, "an amber kite glides"), ("v2", [0.0, 1, 0], None, "wet stones lie all day"), ("v3", [0.0, 0, 1], None, "amber glides kite high"), ("v4", None, None, None), ("v5", None, None, "")]


def test_keywords(records):
    rows = records(*TEXTS)
    found = top(retrieval.bm25(rows, "Amber, KITE amber!", 5))
    assert [x[1] for x in found] == ["v1", "v3"] and found[0][2] == found[1][2]
    assert top(retrieval.bm25_postings(*retrieval.build_postings(rows), "amber kite", 5)) == found
    n, df, tf, dl, avg = 4, 2, 1, 4, 13 / 4
    one = math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert found[0][2] == round(2 * one, 4)
    assert top(retrieval.bm25(rows, "?!", 5)) == []
    assert top(retrieval.bm25(rows, "zebra", 5)) == []


def test_hybrid(records):
    out = top(retrieval.hybrid(records(*TEXTS), [0, 1, 0], "amber kite", "cosine", 10))
    assert [x[1] for x in out] == ["v1", "v3", "v2"]
    both = top(retrieval.hybrid(records(*TEXTS), [1, 0, 0], "amber kite", "cosine", 1))
    assert both == [(1, "v1", round(1 / 61, 4))]
    assert [x[1] for x in top(retrieval.hybrid(records(*TEXTS), [0, 1, 0], "amber", "cosine", 1, alpha=1.0))] == ["v2"]
    assert [x[1] for x in top(retrieval.hybrid(records(*TEXTS), [0, 1, 0], "amber", "cosine", 1, alpha=7, bm25_weight=5.0))] == ["v1"]


def test_keyword_statistics_are_those_of_the_collection(records):
    rows = records(*TEXTS)
    some = top(retrieval.bm25(rows, "amber", 5, F.col("id") == "v3"))
    assert some == [(1, "v3", top(retrieval.bm25(rows, "amber", 5))[1][2])]


def test_pool_size():
    assert retrieval.pool_size(10) == 60 and retrieval.pool_size(5000) == 10_000


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dotproduct"])
def test_inverted_file(spark, tmp_path, metric):
    import numpy as np

    rng = np.random.default_rng(1)
    x = (rng.standard_normal((3000, 16)) * rng.uniform(0.2, 3, (3000, 1))).astype("float32")
    rows = spark.createDataFrame([(f"r{i:04}", "ab"[i % 10 == 0], v.tolist(), None, None) for i, v in enumerate(x)], "id string, namespace string, values array<float>, text_content string, metadata string")
    ann.build(rows, metric, 16).write(str(tmp_path))
    index = ann.read(spark, str(tmp_path))
    assert index.rows.count() == 3000
    hits = 0
    for q in rng.standard_normal((4, 16)):
        exact = {r.id for r in retrieval.dense(rows.where("namespace = 'a'"), q.tolist(), metric, 10).collect()}
        hits += len(exact & {r.id for r in index.search(q.tolist(), 10, "a").collect()})
    assert hits >= 36
    assert len(index.cells(x[0], "a")) < len(index.centroids)
    assert {r.id for r in index.search(x[1].tolist(), 10, "b").collect()} == {r.id for r in retrieval.dense(rows.where("namespace = 'b'"), x[1].tolist(), metric, 10).collect()}


def test_inverted_file_of_nothing(records):
    empty = records(("a", None))
    assert ann.build(empty, "cosine", 8).search([1.0] * 8, 5).count() == 0
