import numpy as np

from stratavec.llm import clusters
from stratavec.llm.vectors import unit

SCHEMA = "rec_no long, collection_name string, namespace string, values array<float>, node long, block int, cluster long, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], SCHEMA)


def brute(rows, threshold=0.7, least=5):
    groups, member = {}, {}
    for r in rows:
        if r[0] is not None and r[3] and len(r[3]) == 16 and np.isfinite(r[3]).all() and np.any(r[3]):
            groups.setdefault((r[1] or "", r[2] or ""), []).append(r)
    pairs = set()
    for mine in groups.values():
        x = unit(np.array([r[3] for r in mine], np.float32), np.float64)
        s = x @ x.T
        label = np.arange(len(mine))
        while True:
            new = np.array([label[s[i] >= threshold].min() for i in range(len(mine))])
            if (new == label).all():
                break
            label = new
        for k in np.unique(label):
            m = np.flatnonzero(label == k)
            if len(m) >= least:
                mean = s[np.ix_(m, m)].mean(1)
                top = min(range(len(m)), key=lambda i: (-round(mean[i], 12), mine[m[i]][0]))
                for i in m:
                    member[mine[i][0]] = len(m)
                    if i != m[top]:
                        pairs.add(tuple(sorted((mine[i][0], mine[m[top]][0]))))
    return pairs, member


def mixed(seed, n, spread=0.35, centres=8):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, 16))
    out = []
    for i in range(n):
        v = rng.standard_normal(16) if i % 9 == 0 else c[rng.integers(centres)] + spread * rng.standard_normal(16)
        out.append((i, "ab"[i % 2], [None, "", "x"][i % 3], v.tolist()))
    return out


def check(spark, rows):
    of = clusters.members(table(spark, rows), 16)
    pairs, member = brute(rows)
    got = of.collect()
    assert {r.rec_no: r.n for r in got if r.cluster is not None} == member
    assert {tuple(r) for r in clusters.typical_pairs(of).collect()} == pairs
    return of, pairs


def test_clusters_and_noise(spark):
    of, pairs = check(spark, mixed(1, 900))
    assert len(pairs) > 300
    first = [r for r in clusters.typical_members(of).collect() if r.place == 1]
    assert {r.rec_no for r in first} <= {x for p in pairs for x in p}


def test_loose_clusters(spark):
    for spread in (0.5, 0.7):
        check(spark, mixed(2, 500, spread, 5))


def test_chains_and_bridges(spark):
    rows = []
    for i in range(60):  # a chain: neighbours are linked, ends are far apart
        a = i * np.pi / 60
        rows.append((i, "c", "", [float(np.cos(a)), float(np.sin(a))] + [0.0] * 14))
    rng = np.random.default_rng(5)
    for k, centre in enumerate(np.eye(16)[4:8]):
        rows += [(100 + 40 * k + i, "c", "", (centre + 0.12 * rng.standard_normal(16)).tolist()) for i in range(30)]
    rows += [(900, "c", "", (np.eye(16)[4] + np.eye(16)[5]).tolist())]  # links two clusters
    check(spark, rows)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 40)
    monkeypatch.setattr(clusters, "FAN_IN", 2)
    check(spark, mixed(3, 600))


def test_unusual_rows(spark):
    a = [1.0] + [0.0] * 15
    rows = [(i, "c", None, a) for i in range(6)] + [(i, "c", "", [2.0] + [0.0] * 15) for i in range(10, 13)] + [(20, "c", "y", a), (21, "c", "", None), (22, "c", "", [0.0] * 16), (23, "c", "", [float("nan")] * 16), (24, "c", "", [1.0]), (None, "c", "", a), (25, None, "", a)]
    of, pairs = check(spark, rows)
    assert pairs == {(0, i) for i in (1, 2, 3, 4, 5, 10, 11, 12)}
    assert clusters.members(table(spark, []), 16).count() == 0
    assert clusters.typical_pairs(clusters.members(table(spark, rows[:4]), 16)).count() == 0


def test_tree_of_many_leaves():
    rng = np.random.default_rng(9)
    c = unit(rng.standard_normal((700, 48)).astype(np.float32))
    x = unit(np.repeat(c, 6, axis=0) + 0.05 * rng.standard_normal((4200, 48)).astype(np.float32))[rng.permutation(4200)]
    tree = clusters.FeatureTree(48)
    leaf = tree.insert(x)
    assert 700 <= tree.leaves <= 900 and len(tree.children) > 10 and max(map(len, tree.children)) <= clusters.BRANCH
    assert sorted(k for m in tree.children for k in m) == list(range(tree.leaves))
    for k, m in enumerate(tree.children):
        assert (tree.node_of[m] == k).all() and np.allclose(tree.nodes[k], tree.sums[m].sum(0), atol=1e-3)
    assert np.allclose(tree.sums[leaf[0]], x[leaf == leaf[0]].sum(0), atol=1e-4)


def test_features_add_up():
    x = unit(np.array([r[3] for r in mixed(4, 700)], np.float32))
    leaf, sums = clusters.cf_leaves(x)
    for k in range(len(sums)):
        assert np.allclose(sums[k], x[leaf == k].sum(0), atol=1e-4)
    parent = clusters.ward(np.bincount(leaf), sums)
    assert (parent[parent] == parent).all() and len(np.unique(parent)) <= len(sums)
    assert clusters.ward(np.array([1]), sums[:1]).tolist() == [0]
