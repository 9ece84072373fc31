"""The most similar vectors of every vector.

An index of cells with four-bit product codes: vectors are given to their nearest cell, and their residual to the
cell's centroid is coded with 16 words a subspace, chosen to keep scores rather than distances: the part of the
residual error that is parallel to the vector costs ``eta`` times the part across, for only it changes the score of
a query that is close.  A query visits its nearest cells; there a table of its products with all words is summed along
the codes of the members (two codes a byte, one look-up of 256), the best are kept and reranked with exact cosines.

Centroids and words are fitted on a bounded sample (SAMPLE rows), everything is indexed.  There is a cell for every CELL_ROWS rows:
beyond MOST_CELLS centroids each cell is divided by centroids of the residuals, which all cells share.  Cells that hold too many
rows are cut into blocks; members of each block meet the rows that ask in tiles, so no group grows with a cell.  Exact copies stand for one another: one of them is
indexed, and results are spread over the class afterwards.

Where only neighbours of a least similarity are asked for, a query visits every cell whose border is near, and reranks every member
whose table score plus coding error could reach its k-th best; and a pair that one of its rows finds counts for the other too.  Two
rows on either side of a border are apart by the sine of their angle at most, and across the border by that times 1 / sqrt(dim) in the
root mean square; a pair is only missed if it reaches further than 2 * BORDER times that, and so stays unseen from both sides.
Else the number of visited cells is fitted on the sample: as many as hold the nearest rows of the sample itself, but for one
in fifty, which lie farther off than those of all rows.

Defined results: rows without a usable vector or a key take no part; no row is its own neighbour, nor is a repeated row of
the same key; equal similarity goes by smaller key; a collection with fewer rows gives fewer neighbours; a null collection is
one of its own; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavec.llm.vectors import copy_classes, first_members, hash_sample, kmeans, matrix, steps, unit, usable_vectors
from stratavec.session import cut_lineage

#: Rows a cell aims at, rows of a block, most centroids, rows that cells and words are fitted on.
CELL_ROWS, BLOCK_ROWS, MOST_CELLS, SAMPLE = 1000, 4000, 16384, 49152
#: Dimensions of a subspace and the cosine that scores matter from (it sets eta).
SUB, SCORE_FROM = 4, 0.2
#: Candidates of a block that are reranked at first, for each neighbour asked for; rows of a task; share of near rows to be held.
RERANK, TASK_ROWS, HOLD = 12, 4096, 0.98
#: How far from a border, in standard deviations across it, a row looks behind it.
BORDER = 2.0


@dataclass
class Index:
    """Cells, the words of each subspace, and blocks of each part of a cell (cell * parts + part)."""

    centroids: np.ndarray
    words: np.ndarray  # subspaces x 16 x SUB
    blocks: np.ndarray
    eta: float
    parts: np.ndarray  # centroids of residuals that divide each cell; one row of zeros if none do

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def own(self, x: np.ndarray) -> np.ndarray:
        """The nearest cell of each row, for any number of rows and cells without a matrix of both."""
        out = np.empty(len(x), np.int64)
        for s in steps(len(x), len(self.centroids)):
            out[s] = (x[s] @ self.centroids.T).argmax(1)
        return out

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells, best first."""
        return self.nearest_with_scores(x, probes)[0]

    def nearest_with_scores(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        score = x @ self.centroids.T
        probes = min(probes, score.shape[1])
        part = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
        best = np.take_along_axis(score, part, 1)
        order = np.argsort(-best, axis=1, kind="stable")
        return np.take_along_axis(part, order, 1), np.take_along_axis(best, order, 1)

    def _part_distances(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Squared distances of the residuals to the centroids of the parts, but for a number that a row's share."""
        return (self.parts**2).sum(1) - 2 * (x - self.centroids[cell]) @ self.parts.T

    def home(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The part that each row, which belongs to the cell, is a member of."""
        return cell * len(self.parts) + (self._part_distances(x, cell).argmin(1) if len(self.parts) > 1 else 0)

    def visits(self, x: np.ndarray, probes: int | None, least: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of what each row's search visits.

        A row y that is a member of c, not of c0, lies on c's side of the plane between the two.  Where its cosine with x reaches
        ``least``, whose angle is t, x lies at most sin t on the other side of it (the same goes for parts, with the chord); BORDER / sqrt(dim)
        of that is looked at."""
        share = min(1.0, BORDER / x.shape[1] ** 0.5)
        score = x @ self.centroids.T
        best = score.argmax(1)
        if least is None:
            near = self.nearest(x, probes)
            row, cell = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
        else:
            c, c0 = self.centroids, self.centroids[best]
            apart = np.sqrt(np.maximum(0, (c * c).sum(1) + (c0 * c0).sum(1)[:, None] - 2 * c0 @ c.T))
            reach = share * (1.0 if least <= 0 else float(np.sqrt(1 - least * least)))
            row, cell = np.nonzero(score >= np.take_along_axis(score, best[:, None], 1) - reach * apart - 1e-4)
        if len(self.parts) == 1:
            return row, cell
        rows, parts, width = [], [], len(self.parts)
        between = np.sqrt(((self.parts[:, None] - self.parts[None]) ** 2).sum(2))
        for s in range(0, len(row), 8192):
            d = self._part_distances(x[row[s : s + 8192]], cell[s : s + 8192])
            if least is None:
                i, j = np.nonzero(np.argsort(np.argsort(d, axis=1), axis=1) < -(-width // 4))
            else:
                first = d.argmin(1)
                chord = share * float(np.sqrt(max(0.0, 2 - 2 * least)))
                i, j = np.nonzero(d - d.min(1, keepdims=True) <= 2 * chord * between[first] + 1e-3)
            rows.append(row[s + i])
            parts.append(cell[s + i] * width + j)
        return (np.concatenate(rows), np.concatenate(parts)) if rows else (row, cell)

    def centre(self, part: int) -> np.ndarray:
        """The centroid that codes of the part's members are relative to: that of their cell."""
        return self.centroids[part // len(self.parts)]

    def codes(self, x: np.ndarray, cell: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Word numbers of each subspace, by coordinate descent on |e|^2 + (eta - 1) (e . x)^2."""
        n, m = len(x), self.words.shape[0]
        r = (x - self.centroids[cell]).reshape(n, m, SUB)
        xs = x.reshape(n, m, SUB)
        codes = np.empty((n, m), np.uint8)
        along = np.zeros((n, m), np.float32)  # e . x of each subspace
        square = (self.words**2).sum(2)
        for k in range(m):
            codes[:, k] = (square[k] - 2 * r[:, k] @ self.words[k].T).argmin(1)
            along[:, k] = ((r[:, k] - self.words[k][codes[:, k]]) * xs[:, k]).sum(1)
        total = along.sum(1)
        for _ in range(sweeps):
            for k in range(m):
                rest = total - along[:, k]
                a = (r[:, k] * xs[:, k]).sum(1)[:, None] - xs[:, k] @ self.words[k].T
                loss = square[k] - 2 * r[:, k] @ self.words[k].T + (self.eta - 1) * (rest[:, None] + a) ** 2
                codes[:, k] = loss.argmin(1)
                along[:, k] = np.take_along_axis(a, codes[:, k : k + 1].astype(np.int64), 1)[:, 0]
                total = rest + along[:, k]
        return codes

    def scan(self, q: np.ndarray, centroid: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate scores of all queries with all members of a cell, by table look-ups along their codes."""
        n, m = len(q), self.words.shape[0]
        table = np.einsum("qms,mws->mqw", q.reshape(n, m, SUB), self.words)
        out = np.repeat((q @ centroid)[:, None], len(packed), axis=1)
        for b in range(packed.shape[1]):
            pair = (table[2 * b][:, :, None] + table[2 * b + 1][:, None, :]).reshape(n, 256)
            out += np.take(pair, packed[:, b], axis=1)
        return out


    def error(self, x: np.ndarray, centroid: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Length of what the codes miss of each member: no score is off by more."""
        m = self.words.shape[0]
        codes = np.empty((len(packed), m), np.int64)
        codes[:, 0::2], codes[:, 1::2] = packed >> 4, packed & 15
        guess = centroid + self.words[np.arange(m), codes].reshape(len(packed), -1)
        return np.sqrt(((x - guess) ** 2).sum(1))


def pack(codes: np.ndarray) -> np.ndarray:
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def fit_index(sample: np.ndarray, rows: int, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> Index:
    """Cells for ``rows`` rows of which ``sample`` are a part; sample rows have length 1."""
    dim = sample.shape[1]
    if dim % (2 * SUB):
        raise ValueError(f"the dimension must be a multiple of {2 * SUB}")
    wanted = max(1, rows // cell_rows)
    cells = max(1, min(MOST_CELLS, wanted, len(sample) // 8))
    centroids = kmeans(sample, cells, 8)
    eta = max(2.0, (dim - 1) * SCORE_FROM**2 / (1 - SCORE_FROM**2))
    index = Index(centroids, np.zeros((dim // SUB, 16, SUB), np.float32), np.ones(len(centroids), np.int64), eta, np.zeros((1, dim), np.float32))
    near = index.own(sample)
    part = slice(0, 8192)
    residual = sample - centroids[near]
    if wanted > MOST_CELLS:
        index.parts = kmeans(residual, max(2, min(-(-wanted // MOST_CELLS), len(sample) // 8)), 8, spherical=False)
    r = residual[part].reshape(-1, dim // SUB, SUB)
    words = [kmeans(np.ascontiguousarray(r[:, k]), 16, 6, spherical=False) for k in range(dim // SUB)]
    index.words = np.stack([np.vstack([w, np.repeat(w[-1:], 16 - len(w), axis=0)]) for w in words])
    for _ in range(2):  # words move to the means of what the score-aware choice gives them
        codes = index.codes(sample[part], near[part], 1)
        for k in range(dim // SUB):
            counts = np.bincount(codes[:, k], minlength=16)
            for s in range(SUB):
                sums = np.bincount(codes[:, k], weights=r[:, k, s], minlength=16)
                index.words[k, :, s] = np.where(counts, sums / np.maximum(counts, 1), index.words[k, :, s])
    counts = np.bincount(index.home(sample, near), minlength=len(centroids) * len(index.parts))
    counts = np.where(counts >= 8, counts * (rows / len(sample)), 0)  # fewer say nothing of a part's size
    index.blocks = np.maximum(1, np.ceil(counts / block_rows)).astype(np.int64)
    return index


def fit_probes(index: Index, sample: np.ndarray, k: int, queries: int = 512) -> int:
    """How many cells hold HOLD of the k nearest rows of the sample of each of its first rows."""
    q = sample[:queries]
    k = min(k, len(sample))
    cell = index.own(sample)
    ranks = []
    for s in steps(len(q), max(len(sample), k * len(index.centroids))):
        score = q[s] @ sample.T
        i = np.arange(len(score))
        score[i, s.start + i] = -2
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        to_cells = q[s] @ index.centroids.T
        ranks.append((to_cells[:, None, :] > np.take_along_axis(to_cells, cell[near], 1)[:, :, None]).sum(2))
    return int(np.quantile(np.concatenate(ranks), HOLD)) + 1


def _top(index: Index, q: np.ndarray, q_keys: np.ndarray, x_keys: np.ndarray, x: np.ndarray, packed: np.ndarray, centroid: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, cosine) of the best ``k`` members of each query that have another key.

    q and x are double-precision unit rows; members come in the order of their keys, for ties."""
    n = len(x)
    keep = min(n, RERANK * k + 1)
    out_q, out_x, out_s = [], [], []
    single = q.astype(np.float32)
    error = None if least is None else index.error(x, centroid, packed)

    def exact(rows: np.ndarray, members: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for p in range(0, len(rows), 16384):
            out[p : p + 16384] = np.einsum("ij,ij->i", q[rows[p : p + 16384]], x[members[p : p + 16384]])
        return out

    for s in range(0, len(q), 256):
        score = index.scan(single[s : s + 256], centroid, packed)
        if keep < n:
            best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        else:
            best = np.broadcast_to(np.arange(n), score.shape)
        row = np.repeat(np.arange(len(score)), best.shape[1])
        member = best.ravel()
        fine = x_keys[member] != q_keys[s + row]
        if least is not None:
            fine &= score[row, member] + error[member] >= least - 1e-4
        row, member = row[fine], member[fine]
        similar = exact(s + row, member)
        if least is not None:
            fine = similar >= least
            row, member, similar = row[fine], member[fine], similar[fine]
            if keep < n:  # what the scores can't rule out, given the k-th best so far
                order = np.lexsort((-similar, row))
                nth = np.arange(len(row)) - np.searchsorted(row[order], row[order])
                floor = np.full(len(score), least)
                floor[row[order][nth == k - 1]] = similar[order][nth == k - 1]
                open_ = score + error >= floor[:, None] - 1e-4
                np.put_along_axis(open_, best, False, axis=1)
                i, j = np.nonzero(open_)
                fine = x_keys[j] != q_keys[s + i]
                i, j = i[fine], j[fine]
                more = exact(s + i, j)
                fine = more >= least
                row, member, similar = np.r_[row, i[fine]], np.r_[member, j[fine]], np.r_[similar, more[fine]]
        order = np.lexsort((member, -similar, row))
        row, member, similar = row[order], member[order], similar[order]
        first = np.searchsorted(row, row)
        fine = np.arange(len(row)) - first < k
        out_q.append(s + row[fine])
        out_x.append(member[fine])
        out_s.append(similar[fine])
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in (out_q, out_x, out_s))


def nearest_neighbours(records: DataFrame, dim: int, k: int, key: str = "rec_no", collection: str = "collection_name", least: float | None = None, queries: Column | None = None, probes: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(key, neighbour, similarity, rank) of the k most similar rows of the same collection.

    least: only neighbours of at least this similarity; then next to none is lost.  probes: cells that are visited otherwise (fitted on the
    sample, if None).  queries: which rows ask (all, if None); all rows answer.
    """
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    vectors = usable_vectors(records.withColumn("_asks", asks), [key, collection, "_asks"], dim)
    classes = copy_classes(vectors, key, [collection])
    n = records.where(F.size("values") == dim).count()
    cells = max(1, min(MOST_CELLS, n // cell_rows))
    wanted = min(SAMPLE, max(4096, 24 * cells))
    drawn = hash_sample(vectors.select(key, "vec"), key, wanted, n).select("vec").toPandas()
    if drawn.empty:
        return records.sparkSession.createDataFrame([], f"`{key}` long, neighbour long, similarity double, rank int")
    sample = unit(matrix(drawn.vec, dim))
    index = fit_index(sample, n, cell_rows)
    if least is None and probes is None:
        probes = fit_probes(index, sample, k)
    shared = records.sparkSession.sparkContext.broadcast(index)

    reps = vectors.join(classes.where(F.col(key) != F.col("rep")).select(key), key, "left_anti")
    heads = classes.where(F.col(key) == F.col("rep")).select(key, F.lit(True).alias("_head"))
    reps = reps.join(heads, key, "left").select(key, collection, (F.col("_asks") | F.col("_head").isNotNull()).alias("_asks"), "vec")
    reps = reps.withColumn("_asks", F.coalesce("_asks", F.lit(False)))
    placed_schema = f"`{key}` long, `{collection}` string, cell int, block long, member boolean, asks boolean, vec binary, code binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, names = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            ask = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            raw = batch.column(3)
            x = unit(matrix(raw.to_pylist(), dim))
            nearest = ix.own(x)
            code = pack(ix.codes(x, nearest))
            own = ix.home(x, nearest)
            home = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % ix.blocks[own]
            turn = (keys.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).astype(np.int64)  # where it asks

            def spread(i: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
                """Each (row, part) once for every block of the part, with the number of blocks."""
                of = ix.blocks[part]
                return np.repeat(i, of), np.repeat(part, of), np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of), np.repeat(of, of)

            # a block's members meet the rows that ask in tiles: members by the one number, those who ask by the other
            i, part, b, of = spread(np.arange(len(x)), own)
            rows, cell_, block, member, asks = [i], [part], [home[i] * of + b], [np.ones(len(i), bool)], [ask[i] & (turn[i] % of == b)]
            asking = np.flatnonzero(ask)
            step = max(64, 2_000_000 // len(ix.centroids))
            for s in range(0, len(asking), step):
                i, part = ix.visits(x[asking[s : s + step]], probes, least)
                i, part, b, of = spread(asking[s : s + step][i], part)
                go = (part != own[i]) | (b != home[i])
                rows.append(i[go])
                cell_.append(part[go])
                block.append((b * of + turn[i] % of)[go])
                member.append(np.zeros(int(go.sum()), bool))
                asks.append(np.ones(int(go.sum()), bool))
            rows, cell_, block, member, asks = map(np.concatenate, (rows, cell_, block, member, asks))
            codes = [c.tobytes() for c in code]
            for s in range(0, len(rows), 20_000):
                r, m = rows[s : s + 20_000], member[s : s + 20_000]
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), names.take(take), pa.array(cell_[s : s + 20_000], pa.int32()), pa.array(block[s : s + 20_000], pa.int64()),
                        pa.array(m), pa.array(asks[s : s + 20_000]), raw.take(take), pa.array([codes[i] if f else None for i, f in zip(r, m)], pa.binary()),
                    ],
                    names=[key, collection, "cell", "block", "member", "asks", "vec", "code"],
                )

    def search(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ix = shared.value
        member, ask = pdf.member.to_numpy(bool), pdf.asks.to_numpy(bool)
        if not member.any() or not ask.any():
            return pd.DataFrame({key: [], "neighbour": [], "similarity": []})
        order = np.argsort(pdf[key].to_numpy(), kind="stable")  # members in the order of keys, for ties
        keys, member, ask = pdf[key].to_numpy()[order], member[order], ask[order]
        u = unit(matrix(pdf.vec.to_numpy()[order], dim), np.float64)
        packed = np.frombuffer(b"".join(pdf.code.to_numpy()[order][member]), np.uint8).reshape(int(member.sum()), -1)
        q, x, s = _top(ix, u[ask], keys[ask], keys[member], u[member], packed, ix.centre(group[1]), k, least)
        return pd.DataFrame({key: keys[ask][q.astype(int)], "neighbour": keys[member][x.astype(int)], "similarity": s})

    tasks = max(records.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    placed = reps.mapInArrow(place, placed_schema).repartition(tasks, collection, "cell", "block")
    found = placed.groupBy(collection, "cell", "block").applyInPandas(search, f"`{key}` long, neighbour long, similarity double")
    if least is not None:  # what the one finds holds for the other
        found = cut_lineage(found)
        back = found.select(F.col("neighbour").alias(key), F.col(key).alias("neighbour"), "similarity")
        found = found.unionByName(back.join(reps.where("_asks").select(key), key, "left_semi") if queries is not None else back).groupBy(key, "neighbour").agg(F.max("similarity").alias("similarity"))
    found = _best(found, key, k).select(F.col(key).alias("_q"), F.col("neighbour").alias("_n"), "similarity")

    own = classes.where(F.col(key) == F.col("rep")).select(F.col("rep").alias("_q"), F.col("rep").alias("_n"), F.lit(1.0).alias("similarity"))
    few = first_members(classes, key, k + 1).select(F.col("rep").alias("_n"), F.col("member").alias("_m"))
    mine = classes.select(F.col("rep").alias("_q"), F.col(key).alias("_k"))
    alone = found.join(classes.select(F.col("rep").alias("_q")).distinct(), "_q", "left_anti").withColumn("_k", F.col("_q"))
    several = found.unionByName(own).join(mine, "_q")  # an inner join, so that a class that holds much of the table may be split
    spread = alone.unionByName(several.select(*alone.columns)).join(few, "_n", "left")
    spread = spread.select(F.col("_k").alias(key), F.coalesce("_m", "_n").alias("neighbour"), "similarity").where(F.col(key) != F.col("neighbour"))
    if queries is not None:
        spread = spread.join(vectors.where("_asks").select(key), key, "left_semi")
    return _best(spread.groupBy(key, "neighbour").agg(F.max("similarity").alias("similarity")), key, k)


def _best(pairs: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_pairs(neighbours: DataFrame, key: str = "rec_no") -> DataFrame:
    """(rec_a, rec_b): the unordered pairs, once each."""
    return neighbours.select(F.least(key, "neighbour").alias("rec_a"), F.greatest(key, "neighbour").alias("rec_b")).distinct()
