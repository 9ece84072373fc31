import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavec.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0, 0) for r in rows], "doc_id long, source string, text string, source_key string, block int, tokens int")


@given(st.lists(st.integers(0, 300), min_size=1, max_size=6), st.integers(1, 33), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_the_tree_splits_exactly(counts, shards, seed):
    out = mixing.split_tree(np.array(counts, np.int64), shards, np.random.default_rng(seed))
    assert out.shape == (shards, len(counts)) and (out.sum(0) == counts).all() and (out >= 0).all()
    assert out.sum(1).max() - out.sum(1).min() <= 2 + shards.bit_length()


def test_mixture(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " big" if i % 2 else "Big\t", " ".join(["word"] * int(rng.integers(1, 30)))) for i in range(3000)]
    rows += [(10_000 + i, "small", " ".join(["word"] * 20)) for i in range(200)] + [(20_000, None, "x"), (20_001, "other", "y"), (20_002, "small", None), (20_003, "small", "")]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.39, 3), ("none", 0.01, 5), ("none", 0.01, 5), (None, 0.1, 1)], TARGETS)
    docs = docs_of(spark, rows)
    info = {r.source: r for r in mixing.shares(docs, targets).collect()}
    assert set(info) == {"big", "small", "none"} and not info["none"].reachable and info["big"].reachable and info["none"].tokens == 0
    mix = mixing.mixture(docs, targets, shards=7).cache()
    assert sorted(mix.groupBy("shard").count().toPandas().shard) == list(range(7))
    assert mix.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    for s in ("big", "small"):
        got = mix.where(f"source = '{s}'").agg({"tokens": "sum"}).first()[0]
        assert abs(got - info[s].quota_tokens) <= 15
        assert mix.where(f"source = '{s}'").agg({"copy": "max"}).first()[0] < info[s].max_repeats
    places = mix.groupBy("shard").agg({"position": "max", "*": "count"}).collect()
    assert all(r["max(position)"] + 1 == r["count(1)"] for r in places)
    again = mixing.mixture(docs, targets, shards=7)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mix.collect()))
    r = {x.source: x for x in mixing.reached(mix, targets).collect()}
    assert abs(sum(x.share for x in r.values()) - 1) < 1e-9 and r["none"].tokens == 0


def test_repeats_cap(spark):
    docs = docs_of(spark, [(i, "a", "word " * 50) for i in range(40)] + [(100 + i, "b", "word " * 50) for i in range(10)])
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 3)], TARGETS)
    mix = mixing.mixture(docs, targets, shards=3)
    assert mix.where("source = 'b'").groupBy("doc_id").count().select("count").distinct().collect()[0][0] == 3
    assert [r.source for r in mixing.shares(docs, targets).where("not reachable").collect()] == ["b"]


def test_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    empty = docs_of(spark, [])
    assert mixing.mixture(empty, targets, shards=2).count() == 0 and mixing.shares(empty, targets).count() == 1
    assert mixing.mixture(docs_of(spark, [(1, "a", "x")]), targets.limit(0)).count() == 0
    assert mixing.reached(mixing.mixture(empty, targets, shards=2), targets).first().share is None


@given(st.lists(st.sampled_from(["word", " ", "\n", "  ", "it's", "12", "\u00a0", "\x1c", "é", "!?", " \n "]), max_size=60).map("".join), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_parts_have_the_tokens_of_the_whole(text, size):
    import base64

    import public_tokenizers
    import tiktoken

    if not hasattr(mixing, "_encoding_of_tests"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
        mixing._encoding_of_tests = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = mixing._encoding_of_tests.encode_ordinary
    assert [t for part in mixing.token_parts(text, size) for t in encode(part)] == encode(text)


def test_blocks_and_shards_grow_with_the_rows(spark):
    docs = docs_of(spark, [(i, "a", "word") for i in range(4000)] + [(10_000, "b", "word")])
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 0.0, 1)], TARGETS)
    tokens = mixing.source_tokens(docs, targets).cache()
    n = {r.source_key: r.n for r in mixing.in_blocks(tokens).groupBy("source_key").agg({"block": "max"}).withColumnRenamed("max(block)", "n").collect()}
    assert n == {"a": 63, "b": 0}
    assert mixing.mixture(docs, targets).select("shard").distinct().count() == 8


def test_short_sources(spark):
    docs = docs_of(spark, [(i, "a", "word " * 50) for i in range(40)] + [(100 + i, "b", "word " * 50) for i in range(10)])
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.7, 3), ("c", 0.1, 3)], TARGETS)
    tokens = mixing.source_tokens(docs, targets).cache()
    r = {x.source: x for x in mixing.reached(mixing.mixture(docs, targets, tokens=tokens), targets, tokens).collect()}
    assert {s: x.short for s, x in r.items()} == {"a": False, "b": True, "c": True} and r["b"].n_rows == 30


def test_long_text_is_counted_whole(spark):
    docs = docs_of(spark, [(1, "a", "word " * 500_000)])
    assert mixing.source_tokens(docs, spark.createDataFrame([("a", 1.0, 1)], TARGETS)).first().tokens >= 500_000
