import random

import pytest

from stratavec.operators.components import components
from stratavec.sources import store as store_module
from stratavec.sources.files import Folder
from stratavec.sources.store import RecordStore
from stratavec.streaming.writes import apply_writes, follow


def test_components(spark):
    rng = random.Random(3)
    edges = [(a, b) for a in range(120) if (b := rng.randrange(240)) != a] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7), (None, 3), (3, 1), (1, 3)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    expected = {x: find(x) for e in edges if None not in e and e[0] != e[1] for x in e}
    out = components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()
    assert {r.node: r.component for r in out} == expected and len(out) == len(expected)
    assert components(spark.createDataFrame([], "u long, v long"), "u", "v").count() == 0


def test_stream_of_writes(spark, tmp_path):
    store = RecordStore(spark, Folder(str(tmp_path / "store")))
    schema = "write_id long, id string, namespace string, op string, values array<float>, text_content string, set_metadata string, received_at timestamp"
    rows = [(1, "a", None, "upsert", [1.0], "t", '{"x":1}'), (1, "a", None, "upsert", [1.0], "t", '{"x":1}'), (2, "b", "", "upsert", [2.0], None, None), (3, "c", "n", "upsert", [3.0], None, None)]
    more = [(4, "a", "", "update", None, None, '{"y":2}'), (5, "b", "", "delete", None, None, None), (6, "zz", "", "update", None, None, "{}")]
    for k, part in enumerate((rows, more)):
        df = spark.createDataFrame([(*r, None) for r in part], schema.replace("received_at timestamp", "s string")).selectExpr("* except (s)", "timestamp'2024-01-01' AS received_at")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "state"))
        query.awaitTermination()
    got = {r.id: (r.namespace, r["values"], r.metadata) for r in store.read().collect()}
    assert got == {"a": ("", [1.0], '{"x":1,"y":2}'), "c": ("n", [3.0], None)}
    store.compact()
    assert store.read().count() == 2 and store.manifest()["deltas"] == []


LOG = "write_id long, id string, namespace string, op string, values array<float>, text_content string, set_metadata string"


def apply(store, spark, *rows):
    apply_writes(store, spark.createDataFrame([(k, id_, None, op, v, t, m) for k, (id_, op, v, t, m) in enumerate(rows)], LOG))
    return {r.id: (r["values"], r.text_content, r.metadata) for r in store.read().collect()}


def test_writes_of_a_batch_are_applied_in_order(spark, tmp_path):
    store = RecordStore(spark, Folder(str(tmp_path)))
    got = apply(store, spark, ("k", "upsert", [1.0], "t", '{"a":1}'), ("k", "update", None, "u", '{"b":2}'), ("z", "upsert", [3.0], None, None), ("gone", "upsert", [3.0], None, None), ("gone", "delete", None, None, None), ("none", "update", [1.0], "x", "{}"))
    assert got == {"k": ([1.0], "u", '{"a":1,"b":2}'), "z": ([3.0], None, None)} and store.manifest()["version"] == 1
    before = store.read().where("id = 'k'").first().created_at
    got = apply(store, spark, ("z", "update", None, None, '{"b":1.50}'), ("z", "update", [4.0], None, '{"c":3,"b":{"x":1}}'), ("z", "update", None, None, "{}"), ("k", "delete", None, None, None), ("k", "upsert", [9.0], None, '{"n":1}'), ("k", "update", None, None, "[1]"), (None, "upsert", [1.0], None, None))
    assert got == {"z": ([4.0], None, '{"b":{"x":1},"c":3}'), "k": ([9.0], None, '{"n":1}')} and store.read().where("id = 'k'").first().created_at > before
    assert apply(store, spark) == got


def test_only_one_writer_commits(spark, tmp_path):
    store = RecordStore(spark, Folder(str(tmp_path)))
    old = store.manifest()
    apply(store, spark, ("a", "upsert", [1.0], None, None))
    with pytest.raises(RuntimeError):
        store._commit(old, deltas=["mine"])
    assert store.manifest()["version"] == 1


def test_deltas_do_not_pile_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_DELTAS", 1)
    store = RecordStore(spark, Folder(str(tmp_path)))
    for k in range(2):
        got = apply(store, spark, ("a", "update", None, f"t{k}", None), (f"b{k}", "upsert", [1.0], None, None))
    assert store.manifest()["deltas"] == [] and len(got) == 2
