import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavec.llm import knn
from stratavec.llm.vectors import unit

SCHEMA = "rec_no long, collection_name string, values array<float>, cell int, block int, vec string, similarity double, rank int, neighbour long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "clash", 0.0, 0, 0) for r in rows], SCHEMA)


def clustered(seed, n, dim=16, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return (c[rng.integers(0, centres, n)] + 0.45 * rng.standard_normal((n, dim))).astype(np.float32)


def brute(rows, k, least=-2.0):
    out = {}
    for c in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == c), key=lambda r: r[0])
        x = unit(np.array([r[2] for r in mine], np.float32), np.float64)
        s = x @ x.T
        for i, r in enumerate(mine):
            order = sorted((j for j in range(len(mine)) if j != i), key=lambda j: (-round(s[i, j], 12), mine[j][0]))[:k]
            out[r[0]] = [mine[j][0] for j in order if s[i, j] >= least]
    return out


def test_recall_and_order(spark):
    rows = [(i, "ab"[i % 3 == 0], v.tolist()) for i, v in enumerate(clustered(1, 1500))]
    found = knn.nearest_neighbours(table(spark, rows), 16, 5, cell_rows=200, probes=4).collect()
    expected, got = brute(rows, 5), {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.rec_no, []).append(r.neighbour)
    assert set(got) == set(expected) and all(len(v) == 5 for v in got.values())
    assert np.mean([len(set(got[k]) & set(expected[k])) / 5 for k in expected]) >= 0.9


@pytest.mark.parametrize("most_cells", [knn.MOST_CELLS, 2])
def test_fitted_probes_hold_the_neighbours(spark, monkeypatch, most_cells):
    monkeypatch.setattr(knn, "MOST_CELLS", most_cells)
    rows = [(i, "c", v.tolist()) for i, v in enumerate(clustered(8, 2000, centres=40))]
    found = knn.nearest_neighbours(table(spark, rows), 16, 5, queries=F.col("rec_no") % 10 == 0, cell_rows=100).collect()
    expected = brute(rows, 5)
    got = {(r.rec_no, r.neighbour) for r in found}
    assert len(found) == 1000 and sum((q, n) in got for q in range(0, 2000, 10) for n in expected[q]) >= 0.9 * 1000


@pytest.mark.parametrize("most_cells", [knn.MOST_CELLS, 3])
def test_close_pairs_are_all_found(spark, monkeypatch, most_cells):
    monkeypatch.setattr(knn, "MOST_CELLS", most_cells)
    monkeypatch.setattr(knn, "RERANK", 1)
    x = clustered(2, 400)
    rng = np.random.default_rng(3)
    near = x[rng.integers(0, 400, 200)] + 0.05 * rng.standard_normal((200, 16)).astype(np.float32)
    rows = [(i, None if i % 5 == 0 else "c", v.tolist()) for i, v in enumerate(np.vstack([x, near]))]
    expected = {(min(a, b), max(a, b)) for a, bs in brute(rows, 5, 0.975).items() for b in bs}
    got = {tuple(r) for r in knn.neighbour_pairs(knn.nearest_neighbours(table(spark, rows), 16, 5, least=0.975, cell_rows=30)).collect()}
    assert got == expected and len(got) > 100


def test_copies_ties_and_unusual_rows(spark):
    a, b = [1.0] + [0.0] * 15, [1.0, 1.0] + [0.0] * 14
    rows = [(i, "c", a) for i in range(10, 22)] + [(30, "c", b), (31, "d", a), (32, "c", None), (33, "c", [0.0] * 16), (34, "c", [float("nan")] * 16), (35, "c", a[:15]), (None, "c", a), (10, "c", a)]
    got = {}
    for r in knn.nearest_neighbours(table(spark, rows), 16, 5).orderBy("rec_no", "rank").collect():
        got.setdefault(r.rec_no, []).append(r.neighbour)
    assert got[10] == [11, 12, 13, 14, 15] and got[12] == [10, 11, 13, 14, 15] and got[21] == [10, 11, 12, 13, 14] and got[30] == [10, 11, 12, 13, 14]
    assert set(got) == {*range(10, 22), 30}


def test_queries_are_a_choice(spark):
    rows = [(i, "c", v.tolist()) for i, v in enumerate(clustered(5, 300))]
    found = knn.nearest_neighbours(table(spark, rows), 16, 3, queries=F.col("rec_no") % 50 == 0, probes=8).collect()
    assert {r.rec_no for r in found} == {0, 50, 100, 150, 200, 250} and len(found) == 18


def test_crowded_cells_are_cut(spark, monkeypatch):
    x = clustered(6, 500, centres=1)
    sample = unit(x)
    index = knn.fit_index(sample, 5000, cell_rows=5000, block_rows=500)
    assert len(index.centroids) == 1 and index.blocks[0] == 10
    rows = [(i, "c", v.tolist()) for i, v in enumerate(x)]
    fit = knn.fit_index
    monkeypatch.setattr(knn, "fit_index", lambda s, n, c: fit(s, n, c, block_rows=120))
    got = {tuple(r) for r in knn.neighbour_pairs(knn.nearest_neighbours(table(spark, rows), 16, 2, least=0.9)).collect()}
    expected = {(min(a, b), max(a, b)) for a, bs in brute(rows, 2, 0.9).items() for b in bs}
    assert len(got & expected) > 0.9 * len(expected) > 100


def test_codes_prefer_small_parallel_error():
    x = unit(clustered(7, 800))
    index = knn.fit_index(x, 800)
    cell = index.nearest(x, 1)[:, 0]
    index.eta, plain = 10.0, knn.Index(index.centroids, index.words, index.blocks, 1.0, index.parts)

    def parallel(codes):
        guess = index.centroids[cell] + index.words[np.arange(4), codes].reshape(len(x), -1)
        return np.abs(((x - guess) * x).sum(1)).mean()

    assert parallel(index.codes(x, cell)) < 0.9 * parallel(plain.codes(x, cell))
    packed = knn.pack(index.codes(x, cell))
    one = cell == cell[0]
    scores, error = index.scan(x[:50], index.centroids[cell[0]], packed[one]), index.error(x[one], index.centroids[cell[0]], packed[one])
    assert (np.abs(scores - x[:50] @ x[one].T) <= error + 1e-4).all()


def test_fit_makes_no_matrix_of_sample_and_cells():
    sample = unit(clustered(9, 16384, centres=500))
    tracemalloc.start()
    try:
        index = knn.fit_index(sample, 2_048_000)
        probes = knn.fit_probes(index, sample, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(index.centroids) == 2048 and peak < 60e6  # the matrix has 134 MB
    near = (sample @ index.centroids.T).argmax(1)
    assert (index.own(sample) == near).mean() > 0.999
    score = sample[:512] @ sample.T
    np.fill_diagonal(score, -2)
    to_cells = sample[:512] @ index.centroids.T
    held = np.take_along_axis(to_cells, near[np.argsort(-score, axis=1)[:, :5]], 1)
    ranks = (to_cells[:, None] > held[:, :, None]).sum(2)
    assert abs(np.quantile(ranks, knn.HOLD) + 1 - probes) <= 1


def test_nothing(spark):
    assert knn.nearest_neighbours(table(spark, []), 16, 5).count() == 0
    with pytest.raises(ValueError):
        knn.fit_index(np.zeros((1, 12), np.float32), 1)
