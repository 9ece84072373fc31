import json

import pytest

from stratavec.errors import EngineError
from stratavec.operators import stages
from stratavec.plugins.rerank import LexicalOverlap, Noop


@pytest.fixture(scope="module")
def matches(spark):
    meta = [{"doc": "n", "text": "red fox"}, {"doc": "s"}, {"doc": "n", "text": "blue fox"}, {}, {"doc": None}, {"doc": 7}, {"doc": "n"}, None, {"doc": 7}]
    rows = [(i + 1, f"m{i + 1}", 0.9 - i * 0.1, None if m is None else json.dumps(m)) for i, m in enumerate(meta)]
    return spark.createDataFrame(rows, "rank int, id string, score double, metadata string").cache()


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_threshold(matches):
    assert ids(stages.threshold(matches, 0.7)) == ["m1", "m2", "m3"]
    assert len(ids(stages.threshold(matches, -1))) == 9


def test_dedup(matches):
    assert ids(stages.dedup(matches, "doc")) == ["m1", "m2", "m4", "m5", "m6", "m8"]
    assert ids(stages.dedup(matches, "absent")) == [f"m{i}" for i in range(1, 10)]


def test_group_by(matches):
    out = [(r.group_rank, r.key, r.member_rank, r.id) for r in stages.group_by(matches, "doc", 4, 2).orderBy("group_rank", "member_rank").collect()]
    assert out == [(1, "n", 1, "m1"), (1, "n", 2, "m3"), (2, "s", 1, "m2"), (3, "", 1, "m4"), (3, "", 2, "m8"), (4, "null", 1, "m5")]


def test_group_by_needs_the_field_somewhere(matches):
    stages.require_field(matches, "doc")
    stages.require_field(matches.limit(0), "doc")
    with pytest.raises(EngineError) as e:
        stages.require_field(matches, "absent")
    assert e.value.code == "GROUPBY_FIELD_MISSING"


def test_truncate(matches):
    assert ids(stages.truncate(matches, 2)) == ["m1", "m2"]
    assert ids(stages.truncate(matches, -1)) == []


def test_rerank(matches):
    assert ids(stages.rerank(matches, Noop(), "fox", 3)) == ["m1", "m2", "m3"]
    out = stages.rerank(matches, LexicalOverlap(), "blue fox", 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in out] == [("m3", 1.0), ("m1", 0.5), ("m2", 0.0)]
    assert ids(stages.rerank(matches, LexicalOverlap(), "m8", 1)) == ["m8"]  # the id stands in for a text
    assert ids(stages.rerank(matches, LexicalOverlap(), "n", 1, "doc")) == ["m1"]
    assert ids(stages.rerank(matches.limit(0), LexicalOverlap(), "x", 5)) == []
