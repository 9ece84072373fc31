import itertools
import random

import numpy as np
import pytest

from stratavec.functions.text import words
from stratavec.llm import similarity as sim

SCHEMA = "rec_no long, collection_name string, namespace string, values array<float>, text_content string, plain string, vec string, n int, sketch string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, "clash") for r in rows], SCHEMA)


def corpus(seed, n):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(900)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(lexicon) for _ in range(rng.randint(20, 90))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = [rng.choice(lexicon)] * rng.randint(0, 1)
            texts.append(rng.choice([" ", ", ", "\n"]).join(w))
    return texts


def brute(texts, threshold, shingle, least):
    sets = {i: {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} for i, t in enumerate(texts) if t is not None and len(w := words(t)) >= max(least, shingle)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize(("threshold", "shingle", "least"), [(0.6, 3, 20), (0.8, 5, None)])
def test_texts(spark, threshold, shingle, least):
    texts = [*corpus(1, 250), None, "", " \n", "short text", "word " * 30, "word " * 31, "x" * 100_000, "a b c d e " * 20_000]
    df = table(spark, [(i, "c", "", None, t) for i, t in enumerate(texts)] + [(None, "c", "", None, texts[0])])
    got = {(r.a, r.b) for r in sim.text_links(df, threshold, shingle, least).collect()}
    assert got == brute(texts, threshold, shingle, least or 0) and len(got) > 30


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 4)):
            rows.append((len(rows), "ab"[i % 2], "", (base * rng.uniform(0.1, 9) + rng.choice([0, 0.001, 0.02]) * rng.standard_normal(16)).tolist(), None))
    rows += [(len(rows) + k, "a", "", v, None) for k, v in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15, [1e-30] * 16, [1e30] * 16, [3.0] * 16])]
    df = table(spark, rows)
    x = {r[0]: np.array(r[3], np.float32).astype(float) for r in rows if r[3] and len(r[3]) == 16 and np.isfinite(r[3]).all() and np.any(r[3])}
    x = {k: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for k, v in x.items()}
    expected = {(a, b) for a, b in itertools.combinations(sorted(x), 2) if rows[a][1] == rows[b][1] and x[a] @ x[b] >= 0.9995}
    got = {(r.a, r.b) for r in sim.vector_links(df, 16, 0.9995).collect()}
    assert got == expected and len(got) > 30


def test_large_class_of_copies_is_a_star(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(i, "c", "", [1.0] * 8, text if i % 2 else text.upper()) for i in range(60)] + [(99, "c", "", [1.0] * 7 + [1.001], text + " more"), (7, "c", "", [1.0] * 8, text)]
    links = sim.text_links(table(spark, rows), 0.6, 3, 20)
    assert {(r.a, r.b) for r in links.collect()} == {(0, i) for i in range(1, 60)} | {(0, 99)}
    assert {(r.a, r.b) for r in sim.vector_links(table(spark, rows), 8).collect()} == {(0, i) for i in range(1, 60)} | {(0, 99)}
    groups = sim.linked_groups(table(spark, rows[:61]), sim.text_pairs(table(spark, rows[:61]), 0.6, 3, 20)).collect()
    assert {r.group for r in groups} == {0} and {r.n_links for r in groups} == {60}


@pytest.mark.parametrize("copies", [3, 51])
def test_links_are_counted_in_classes_of_any_size(spark, copies):
    w = [f"t{i}" for i in range(40)]
    texts = [" ".join(w)] * copies + [" ".join([*w, "more"]), " ".join(w[:38]), "short", None] + [" ".join(f"u{i}" for i in range(30))] * 2
    vectors = [[1.0] * 8, [1.0] * 7 + [1.001], [1.0, -1.0] * 4, None, [5.0] + [0.0] * 7]
    rows = [(i, "ab"[i % 7 == 0], "", vectors[i % 5], t) for i, t in enumerate(texts)]
    df = table(spark, rows)
    near = brute(texts, 0.6, 3, 20)
    unit = [None if v is None else np.array(v) / np.linalg.norm(v) for v in vectors]
    close = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if rows[a][1] == rows[b][1] and (x := unit[a % 5]) is not None and (y := unit[b % 5]) is not None and x @ y >= 0.9995}
    for links, sides in ((near, [sim.text_pairs(df, 0.6, 3, 20)]), (near | close, [sim.text_pairs(df, 0.6, 3, 20), sim.vector_pairs(df, 8)])):
        expected = {i: sum(i in e for e in links) for i in range(len(rows))}
        got = sim.linked_groups(df, *sides).collect()
        assert {r.rec_no: r.n_links for r in got} == expected and len(got) == len(rows)
        group = {i: i for i in range(len(rows))}
        for _ in rows:
            for a, b in links:
                group[a] = group[b] = min(group[a], group[b])
        assert {(r.rec_no, r.group) for r in got} == set(group.items())
    assert expected[0] >= copies


def test_crowded_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(sim, "TILE_ROWS", 20)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(220):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        texts.append(" ".join(w))
    got = {(r.a, r.b) for r in sim.text_links(table(spark, [(i, "c", "", None, t) for i, t in enumerate(texts)]), 0.6, 3, 20).collect()}
    assert got == brute(texts, 0.6, 3, 20) and len(got) > 20_000


def test_nothing(spark):
    empty = table(spark, [])
    assert sim.text_links(empty).count() == 0 and sim.vector_links(empty, 8).count() == 0
    assert sim.linked_groups(empty, sim.text_pairs(empty)).count() == 0


@pytest.mark.parametrize("agree", [0.3, 0.5, 0.6, 0.8, 0.95, 0.99, 1.0])
def test_bands_fit_the_threshold(agree):
    bands, per = sim.band_layout(agree, 0.001)
    assert bands * per <= sim.BITS and (1 - agree**per) ** bands <= 0.001


def test_thresholds_that_are_too_low():
    with pytest.raises(ValueError):
        sim.band_layout(0.01, 0.001)


def test_low_thresholds_are_met(spark):
    texts = corpus(3, 120)
    df = table(spark, [(i, "c", "", None, t) for i, t in enumerate(texts)])
    assert {(r.a, r.b) for r in sim.text_links(df, 0.3, 2).collect()} == brute(texts, 0.3, 2, 0)
