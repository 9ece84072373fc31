"""Clusters of mutually similar vectors, by size and most typical members.

Rows are linked if their cosine reaches the threshold and they share a group (collection and namespace); a cluster is a
connected set of at least ``min_size`` rows.  Finding them takes five steps, each spread over (group, block of rows):

1. every block builds the leaves of a cluster-feature tree: (count, linear sum) summaries with a few exemplars;
2. the leaves of a group are merged by Ward's criterion, FAN_IN blocks at a time and level by level until one is left, into centres,
   each with *hubs*: exemplars that are linked to one another; a node passes its MOST_LEAVES largest leaves on;
3. one pass assigns every row to its nearest centre; a row linked to a hub of it is a core row and needs no more;
4. the exact check: rows that aren't core, rows that lie towards another centre too, and the rows of a centre that lies
   close to a larger one, are compared with all rows of their group, in blocks; what they link is joined by connected
   components;
5. members are ranked by their mean similarity to all members, which is their product with the members' mean.

Summaries only save work: a leaf that is left out makes its rows be checked in step 4.  The one thing taken on trust is
that core rows of two centres aren't linked to each other if each has a cosine under TOWARDS with the other's centre.

Scale: groups are cut into blocks of BLOCK_ROWS, so one that holds a third of all rows is many tasks; centres (MOST_LEAVES of a group at
most), and the rows to be checked, are copied to the blocks of their group.  Step 5 joins by node and by cluster.  Step 4 costs (rows to check) x (rows of the group).

Defined results: rows without a usable vector or a key are in no cluster and no result; a null namespace or collection
counts as ''; a key that is repeated counts as many rows; the most
typical of equals is the smaller key; exact copies are rows like others; an empty table gives empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavec.llm.vectors import matrix, unit, usable_vectors
from stratavec.operators.components import components
from stratavec.session import cut_lineage

BLOCK_ROWS = 32768
#: Blocks whose leaves are merged at once; leaves that are passed on; exemplars kept of a leaf; hubs of a centre.
FAN_IN, MOST_LEAVES, EXEMPLARS, HUBS = 16, 1024, 4, 8
#: Leaves of a node of a feature tree; nodes that a row goes down.
BRANCH, DESCEND = 64, 3
#: Cosine a row needs to join a leaf; centres that may be merged; centres, and rows and other centres, that are checked.
LEAF, MERGE, NEIGHBOUR, TOWARDS = 0.72, 0.6, 0.4, 0.45
_CHUNK = 2048
_EPS = 1e-5  # single-precision screening before the double-precision test

_LEAVES = "collection_name string, namespace string, block int, n long, ls binary, heads array<long>, examples binary"


class FeatureTree:
    """A cluster-feature tree of two levels: nodes of at most BRANCH leaves, each a (count, linear sum).

    A row goes down the DESCEND nodes it is closest to, and joins the closest of their leaves if its cosine is at least
    ``least``, else it starts a leaf.  Rows come in chunks; those that start leaves gather around the first of them.  Trees
    are merged by their leaves, for features add up.
    """

    def __init__(self, dim: int, least: float = LEAF):
        self.least, self.leaves = least, 0
        self.sums, self.node_of = np.zeros((64, dim)), np.zeros(64, np.int64)
        self.children: list[list[int]] = [[]]
        self.nodes = np.zeros((1, dim))

    def _closest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, cosine) of each row; -1 if there is none."""
        leaf, best = np.full(len(x), -1, np.int64), np.full(len(x), -2.0, np.float32)
        if len(self.children) <= DESCEND:
            chosen = [(k, np.arange(len(x))) for k in range(len(self.children)) if self.children[k]]
        else:
            pick = np.argpartition(-(x @ unit(self.nodes).T), DESCEND - 1, axis=1)[:, :DESCEND]
            row, node = np.repeat(np.arange(len(x)), DESCEND), pick.ravel()
            order = np.argsort(node, kind="stable")
            chosen = [(int(node[g[0]]), row[g]) for g in np.split(order, np.flatnonzero(np.diff(node[order])) + 1)]
        for k, rows in chosen:
            mine = np.array(self.children[k])
            score = x[rows] @ unit(self.sums[mine]).T
            top = score.argmax(1)
            value = score[np.arange(len(rows)), top]
            better = value > best[rows]
            leaf[rows[better]], best[rows[better]] = mine[top[better]], value[better]
        return leaf, best

    def _new_leaf(self, total: np.ndarray) -> int:
        if self.leaves == len(self.sums):
            self.sums, self.node_of = np.vstack([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.node_of, np.zeros_like(self.node_of)])
        k, self.leaves = self.leaves, self.leaves + 1
        self.sums[k] = total
        node = int((self.nodes @ total / np.maximum(np.sqrt((self.nodes**2).sum(1)), 1e-30)).argmax())
        self.node_of[k] = node
        self.children[node].append(k)
        self.nodes[node] += total
        if len(self.children[node]) > BRANCH:
            self._split(node)
        return k

    def _split(self, node: int) -> None:
        """Leaves go with the one of two far ones that they are closer to."""
        mine = np.array(self.children[node])
        c = unit(self.sums[mine])
        a = int((c @ self.nodes[node]).argmin())
        b = int((c @ c[a]).argmin())
        with_b = c @ c[b] > c @ c[a]
        with_b[b], with_b[a] = True, False
        self.children[node] = mine[~with_b].tolist()
        self.children.append(mine[with_b].tolist())
        self.nodes = np.vstack([self.nodes, self.sums[mine[with_b]].sum(0)[None]])
        self.nodes[node] = self.sums[mine[~with_b]].sum(0)
        self.node_of[mine[with_b]] = len(self.children) - 1

    def insert(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.empty(len(x), np.int64)
        for s in range(0, len(x), _CHUNK):
            part = x[s : s + _CHUNK]
            leaf, best = self._closest(part)
            leaf[best < self.least] = -1
            fits = np.flatnonzero(leaf >= 0)
            np.add.at(self.sums, leaf[fits], part[fits])
            np.add.at(self.nodes, self.node_of[leaf[fits]], part[fits])
            rest = np.flatnonzero(leaf < 0)
            while len(rest):
                joins = part[rest] @ part[rest[0]] >= self.least
                joins[0] = True
                leaf[rest[joins]] = self._new_leaf(part[rest[joins]].sum(0, dtype=np.float64))
                rest = rest[~joins]
            out[s : s + _CHUNK] = leaf
        return out


def cf_leaves(x: np.ndarray, least: float = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(leaf of each row, linear sums of the leaves) of a tree of the rows."""
    tree = FeatureTree(x.shape[1], least)
    leaf = tree.insert(x)
    return leaf, tree.sums[: tree.leaves]


def _exemplars(x: np.ndarray, keys: np.ndarray, leaf: np.ndarray, sums: np.ndarray, most: int) -> list[np.ndarray]:
    """Of each leaf the rows nearest to its centroid."""
    closeness = np.einsum("ij,ij->i", x, unit(sums)[leaf])
    order = np.lexsort((keys, -closeness, leaf))
    rank = np.arange(len(order)) - np.searchsorted(leaf[order], leaf[order])
    chosen = order[rank < most]
    return np.split(chosen, np.flatnonzero(np.diff(leaf[chosen])) + 1) if len(chosen) else []


def _close_pairs(c: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of unit rows whose cosine is at least ``least``, block by block."""
    left, right = [], []
    for s in range(0, len(c), 1024):
        i, j = np.nonzero(c[s : s + 1024] @ c[s:].T >= least)
        fine = j > i
        left.append(i[fine] + s)
        right.append(j[fine] + s)
    return np.concatenate(left), np.concatenate(right)


def ward(n: np.ndarray, sums: np.ndarray, least: float = MERGE) -> np.ndarray:
    """Centre of each leaf: the cheapest merge by Ward's criterion first, as long as centroids' cosine is ``least``."""
    parent = np.arange(len(n))
    n, sums = n.astype(np.float64).copy(), sums.astype(np.float64).copy()
    if len(n) < 2:
        return parent
    near: list[set[int]] = [set() for _ in n]
    for i, j in zip(*(a.tolist() for a in _close_pairs(unit(sums), least))):
        near[i].add(j)
        near[j].add(i)
    version = [0] * len(n)

    def cost(i: int, j: int) -> float | None:
        a, b = sums[i], sums[j]
        if a @ b < least * np.sqrt((a @ a) * (b @ b)):
            return None
        d = a / n[i] - b / n[j]
        return n[i] * n[j] / (n[i] + n[j]) * (d @ d)

    heap = [(c, i, j, 0, 0) for i in range(len(n)) for j in near[i] if i < j and (c := cost(i, j)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, vi, vj = heapq.heappop(heap)
        if version[i] != vi or version[j] != vj:
            continue
        parent[j] = i
        n[i] += n[j]
        sums[i] += sums[j]
        version[i] += 1
        version[j] = -1
        near[i] = {k for k in near[i] | near[j] if k not in (i, j) and version[k] >= 0}
        for k in near[i]:
            near[k].discard(j)
            near[k].add(i)
            if (c := cost(i, k)) is not None:
                heapq.heappush(heap, (c, i, k, version[i], version[k]))
    for k in range(len(parent)):
        while parent[parent[k]] != parent[k]:
            parent[k] = parent[parent[k]]
    return parent


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.get(x, x)) != x:
            root[x] = root.get(p, p)
            x = p
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = find(x), find(y)
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((x, y))
    return out


def _blocks_of(records: DataFrame, dim: int) -> DataFrame:
    group = [F.coalesce("collection_name", F.lit("")).alias("collection_name"), F.coalesce("namespace", F.lit("")).alias("namespace")]
    counts = records.where(F.size("values") == dim).groupBy(*group).count()
    return counts.select("collection_name", "namespace", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))


def _to_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each row once for every block of its group."""
    spread = rows.join(blocks, ["collection_name", "namespace"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return spread.select(*[F.col(c).alias(f"_{c}") for c in spread.columns]).toDF(*spread.columns)  # columns of their own, for the cogroup


def _assigned(records: DataFrame, dim: int, threshold: float, blocks: DataFrame) -> DataFrame:
    """(collection_name, namespace, block, rec_no, node, check, vec): node is a hub's rec_no for a core row, else the row's own."""
    named = records.select("rec_no", F.coalesce("collection_name", F.lit("")).alias("collection_name"), F.coalesce("namespace", F.lit("")).alias("namespace"), "values")
    rows = usable_vectors(named, ["rec_no", "collection_name", "namespace"], dim).join(blocks, ["collection_name", "namespace"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rec_no"), F.col("blocks")).cast("int"))
    at = ["collection_name", "namespace", "block"]

    def leaves(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(matrix(pdf.vec, dim))
        keys = pdf.rec_no.to_numpy()
        leaf, sums = cf_leaves(x)
        counts = np.bincount(leaf, minlength=len(sums))
        out = [(*key[:2], key[2] // FAN_IN, int(counts[k]), sums[k].tobytes(), keys[e].tolist(), x[e].tobytes()) for k, e in enumerate(_exemplars(x, keys, leaf, sums, EXEMPLARS)) if counts[k] > 1]
        out = sorted(out, key=lambda o: -o[3])[:MOST_LEAVES]
        return pd.DataFrame(out, columns=["collection_name", "namespace", "block", "n", "ls", "heads", "examples"])

    def agglomerate(pdf: pd.DataFrame, hubs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, linear sum, keys of the exemplars, exemplars) of each centre."""
        n, sums = pdf.n.to_numpy(), np.frombuffer(b"".join(pdf.ls), np.float64).reshape(-1, dim)
        parent = ward(n, sums)
        order = np.argsort(parent, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(parent[order])) + 1):
            total = sums[mine].sum(0)
            keys = np.concatenate([np.asarray(pdf.heads.iloc[k], np.int64) for k in mine])
            x = np.concatenate([matrix([pdf.examples.iloc[k]], dim) for k in mine])
            best = np.lexsort((keys, -(x @ total)))[:hubs]
            yield int(n[mine].sum()), total, keys[best], x[best]

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(*key[:2], key[2] // FAN_IN, n, total.tobytes(), keys.tolist(), x.tobytes()) for n, total, keys, x in agglomerate(pdf, EXEMPLARS)]
        out = sorted(out, key=lambda o: -o[3])[:MOST_LEAVES]
        return pd.DataFrame(out, columns=["collection_name", "namespace", "block", "n", "ls", "heads", "examples"])

    def centres(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = list(agglomerate(pdf, 4 * HUBS))
        c = unit(np.stack([f[1] for f in found]))
        n = np.array([f[0] for f in found])
        check = np.zeros(len(found), bool)
        for i, j in zip(*_close_pairs(c, NEIGHBOUR)):
            check[i if n[i] < n[j] else j] = True
        out = []
        for k, (_, _, keys, x) in enumerate(found):
            linked = np.flatnonzero(x.astype(np.float64) @ x[0].astype(np.float64) >= threshold + _EPS)
            linked = np.unique(np.r_[0, linked])[:HUBS]
            out.append((*key, int(keys[0]), bool(check[k]), c[k].tobytes(), x[linked].tobytes()))
        return pd.DataFrame(out, columns=["collection_name", "namespace", "hub", "check", "centroid", "hubs"])

    def assign(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = left.rec_no.to_numpy()
        node, check = keys.copy(), np.ones(len(left), bool)
        if len(right) and len(left):
            x = unit(matrix(left.vec, dim))
            c = matrix(right.centroid, dim)
            near, towards = np.empty(len(x), np.int64), np.zeros(len(x), bool)
            for s in range(0, len(x), _CHUNK):
                score = x[s : s + _CHUNK] @ c.T
                near[s : s + _CHUNK] = best = score.argmax(1)
                score[np.arange(len(score)), best] = -2
                towards[s : s + _CHUNK] = score.max(1) >= TOWARDS
            order = np.argsort(near, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
                k = near[mine[0]]
                core = (x[mine] @ matrix([right.hubs.iloc[k]], dim).T).max(1) >= threshold + _EPS
                node[mine[core]] = right.hub.iloc[k]
                check[mine[core]] = right.check.iloc[k] | towards[mine[core]]
        return left.assign(node=node, check=check)[[*at, "rec_no", "node", "check", "vec"]]

    level = rows.groupBy(*at).applyInPandas(leaves, _LEAVES)
    nodes = blocks.agg(F.max("blocks")).first()[0] or 1  # of the largest group
    while (nodes := -(-nodes // FAN_IN)) > 1:
        level = level.groupBy(*at).applyInPandas(merge, _LEAVES)
    found = level.groupBy("collection_name", "namespace").applyInPandas(centres, "collection_name string, namespace string, hub long, check boolean, centroid binary, hubs binary")
    cut = found.select("collection_name", "namespace", "hub", "check", "centroid", "hubs")
    return rows.groupBy(*at).cogroup(_to_blocks(cut, blocks).groupBy(*at)).applyInPandas(assign, "collection_name string, namespace string, block int, rec_no long, node long, check boolean, vec binary")


def members(records: DataFrame, dim: int, threshold: float = 0.7, min_size: int = 5) -> DataFrame:
    """(rec_no, cluster, n, mean_similarity) of every row with a usable vector; cluster is null for rows in none.

    cluster is the smallest node of the cluster's parts; mean_similarity is taken over all members, the row itself too.
    """
    blocks = cut_lineage(_blocks_of(records, dim))
    at = ["collection_name", "namespace", "block"]
    rows = cut_lineage(_assigned(records, dim, threshold, blocks))

    def link(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        edges: list[tuple[int, int]] = []
        if len(left) and len(right):
            x, y = unit(matrix(right.vec, dim)), unit(matrix(left.vec, dim))
            mine, other = right.node.to_numpy(), left.node.to_numpy()
            step = max(1, 16_000_000 // len(y))
            for s in range(0, len(x), step):
                i, j = np.nonzero(x[s : s + step] @ y.T >= threshold - _EPS)
                i += s
                fine = mine[i] != other[j]
                i, j = i[fine], j[fine]
                exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", unit(matrix(right.vec.to_numpy()[i[p : p + 8192]], dim), np.float64), unit(matrix(left.vec.to_numpy()[j[p : p + 8192]], dim), np.float64)) for p in range(0, len(i), 8192))])
                fine = exact >= threshold
                pairs = np.unique(np.stack([mine[i[fine]], other[j[fine]]], axis=1), axis=0)
                edges = _forest(*np.concatenate([np.array(edges, np.int64).reshape(-1, 2), pairs]).T)
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    asking = _to_blocks(rows.where("check").select("collection_name", "namespace", "node", "vec"), blocks)
    edges = rows.select(*at, "node", "vec").groupBy(*at).cogroup(asking.groupBy(*at)).applyInPandas(link, "a long, b long")
    joined = components(edges, "a", "b").withColumnRenamed("node", "_node")

    def partial(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(matrix(pdf.vec, dim), np.float64)
        nodes, inverse = np.unique(pdf.node.to_numpy(), return_inverse=True)
        sums = np.zeros((len(nodes), dim))
        np.add.at(sums, inverse, x)
        return pd.DataFrame({"collection_name": key[0], "namespace": key[1], "node": nodes, "n": np.bincount(inverse), "ls": [s.tobytes() for s in sums]})

    def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ls = np.frombuffer(b"".join(pdf.ls), np.float64).reshape(-1, dim).sum(0)
        return pd.DataFrame({"cluster": [key[0]], "n": [int(pdf.n.sum())], "ls": [ls.tobytes()]})

    parts = rows.select(*at, "node", "vec").groupBy(*at).applyInPandas(partial, "collection_name string, namespace string, node long, n long, ls binary")
    parts = parts.join(joined, F.col("node") == F.col("_node"), "left").withColumn("cluster", F.coalesce("component", "node")).drop("_node", "component")
    sizes = parts.groupBy("cluster").agg(F.sum("n").alias("n")).where(F.col("n") >= min_size).select("cluster")
    kept = parts.join(sizes, "cluster", "left_semi")
    sums = kept.groupBy("cluster").applyInPandas(total, "cluster long, n long, ls binary")
    group = ["collection_name", "namespace", "node"]
    of = kept.select(*group, "cluster").distinct()
    placed = rows.select(*group, "rec_no", "vec").join(of, group, "left").join(sums, "cluster", "left").select("rec_no", "cluster", "n", "vec", "ls")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            mean = np.full(batch.num_rows, np.nan)
            for s in range(0, len(inside), _CHUNK):
                take = pa.array(inside[s : s + _CHUNK])
                x = unit(matrix(batch.column(3).take(take).to_pylist(), dim), np.float64)
                ls = np.frombuffer(b"".join(batch.column(4).take(take).to_pylist()), np.float64).reshape(-1, dim)
                mean[inside[s : s + _CHUNK]] = np.einsum("ij,ij->i", x, ls) / batch.column(2).take(take).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mean, mask=np.isnan(mean))], names=["rec_no", "cluster", "n", "mean_similarity"])

    return cut_lineage(placed.mapInArrow(rank, "rec_no long, cluster long, n long, mean_similarity double"))


def _typical_first() -> list:
    return [F.desc(F.round("mean_similarity", 12)), F.col("rec_no")]


def typical_members(of: DataFrame, most: int = 3) -> DataFrame:
    """(cluster, n, place, rec_no, mean_similarity): the size and the ``most`` most typical members of each cluster."""
    w = Window.partitionBy("cluster").orderBy(*_typical_first())
    return of.where("cluster is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("cluster", "n", "place", "rec_no", "mean_similarity")


def typical_pairs(of: DataFrame) -> DataFrame:
    """(rec_a, rec_b): the most typical member of each cluster with each other member, smaller key first."""
    inside = of.where("cluster is not null")
    best = F.max(F.struct(F.round("mean_similarity", 12).alias("s"), (-F.col("rec_no")).alias("k"))).alias("b")
    top = inside.groupBy("cluster").agg(best).select("cluster", (-F.col("b.k")).alias("top"))
    return inside.join(top, "cluster").where("rec_no != top").select(F.least("rec_no", "top").alias("rec_a"), F.greatest("rec_no", "top").alias("rec_b"))
