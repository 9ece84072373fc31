"""An inverted-file index for approximate top-k: rows by nearest centroid, a query visits the nearest cells.

Nearness is Euclidean in a space made for the metric: directions for the cosine; for the inner product rows get one number more
that makes all of one length, so that the nearest rows are those of the highest product.  Centroids are fitted on a bounded sample
(``sample_rows``); every row is indexed.  The share of a namespace's rows that a query visits is fitted on the sample too: as much
as holds HOLD of the ten nearest rows of the sample, and FLOOR_ROWS at least.  Rows are written in the order of namespace and cell,
so that the files' statistics leave out the cells that aren't visited.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.operators.retrieval import dense

HOLD, FLOOR_ROWS = 0.97, 2000


class InvertedFile:
    """centroids and scale: see _space; rows: the records with their cell; sizes: (namespace, cell, count)."""

    def __init__(self, centroids: np.ndarray, scale: float, share: float, metric: str, rows: DataFrame, sizes: DataFrame):
        self.centroids, self.scale, self.share, self.metric, self.rows, self.sizes = centroids, scale, share, metric, rows, sizes

    def cells(self, vector: Sequence[float], namespace: str | None = None) -> list[int]:
        """The nearest cells that together hold the share of the rows."""
        sizes = self.sizes if namespace is None else self.sizes.where(F.col("namespace") == namespace)
        counts = np.zeros(len(self.centroids), np.int64)
        for cell, n in sizes.groupBy("cell").agg(F.sum("count")).collect():  # a row a cell
            counts[cell] = n
        order = np.argsort(_distances(self.centroids, _query(np.asarray(vector, np.float64)[None], self.metric, self.scale))[0])
        enough = max(self.share * counts.sum(), FLOOR_ROWS)
        seen = np.cumsum(counts[order]) - counts[order]
        return [int(c) for c in order[(seen < enough) & (counts[order] > 0)]]

    def candidates(self, vector: Sequence[float], namespace: str | None = None) -> DataFrame:
        rows = self.rows.where(F.col("cell").isin(self.cells(vector, namespace))).drop("cell")
        return rows if namespace is None else rows.where(F.col("namespace") == namespace)

    def search(self, vector: Sequence[float], k: int, namespace: str | None = None) -> DataFrame:
        return dense(self.candidates(vector, namespace), vector, self.metric, k)

    def write(self, folder: str) -> None:
        self.rows.repartitionByRange("namespace", "cell").sortWithinPartitions("namespace", "cell").write.mode("overwrite").parquet(f"{folder}/rows")
        spark = self.rows.sparkSession
        self.sizes.write.mode("overwrite").parquet(f"{folder}/sizes")
        head = [(self.metric, self.scale, self.share, self.centroids.shape[1], self.centroids.ravel().tolist())]
        spark.createDataFrame(head, "metric string, scale double, share double, dim int, centroids array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/head")


def read(spark: SparkSession, folder: str) -> InvertedFile:
    head = spark.read.parquet(f"{folder}/head").first()
    centroids = np.array(head.centroids).reshape(-1, head.dim)
    return InvertedFile(centroids, head.scale, head.share, head.metric, spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/sizes"))


def _distances(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (c * c).sum(1) - 2 * x @ c.T


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)


def _space(x: np.ndarray, metric: str, scale: float) -> np.ndarray:
    """Rows in the space of the metric; scale: the greatest length of a sample's row."""
    x = np.nan_to_num(x, posinf=0, neginf=0)
    if metric == "cosine":
        return _directions(x)
    if metric == "euclidean":
        return x
    return np.hstack([x, np.sqrt(np.maximum(0, scale * scale - (x * x).sum(1, keepdims=True)))])


def _query(q: np.ndarray, metric: str, scale: float) -> np.ndarray:
    if metric == "cosine":
        return _directions(q)
    return q if metric == "euclidean" else np.hstack([_directions(q) * scale, np.zeros((len(q), 1))])


def _fit_share(x: np.ndarray, q: np.ndarray, c: np.ndarray, k: int = 10) -> float:
    """Of the rows, the share in the cells that come before the last that HOLD of the queries' near rows are in."""
    cell = np.concatenate([_distances(c, x[s : s + 4096]).argmin(1) for s in range(0, len(x), 4096)])
    counts = np.bincount(cell, minlength=len(c))
    near = np.argpartition(_distances(x, q), min(k, len(x) - 1), axis=1)[:, : k + 1]
    order = np.argsort(_distances(c, q), axis=1)
    seen = np.cumsum(counts[order], axis=1)
    rank = np.argsort(order, axis=1)
    return float(np.quantile(np.take_along_axis(seen, np.take_along_axis(rank, cell[near], 1), 1), HOLD) / len(x))


def build(records: DataFrame, metric: str, dim: int, cells: int | None = None, sample_rows: int = 20_000, seed: int = 3) -> InvertedFile:
    """About sqrt(n) cells, unless given, and no more than an eighth of the sample; rows without a vector of the dimension aren't indexed."""
    usable = records.where(F.size("values") == dim)
    n = usable.count()
    share = min(1.0, sample_rows / max(1, n))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(seed), "id", "namespace"), F.lit(1 << 30)) < int(share * (1 << 30))).select("values").limit(2 * sample_rows).toPandas()
    raw = np.stack(drawn["values"].to_numpy()).astype(np.float64) if len(drawn) else np.zeros((1, dim))
    raw = raw[np.isfinite(raw).all(1)] if np.isfinite(raw).all(1).any() else np.zeros((1, dim))
    scale = float(np.sqrt((raw * raw).sum(1)).max())
    x = _space(raw, metric, scale)
    rng = np.random.default_rng(seed)
    wanted = max(1, min(round(n**0.5) if cells is None else cells, max(1, len(x) // 8)))
    c = x[rng.choice(len(x), wanted, replace=False)]
    for _ in range(8):
        near = np.concatenate([_distances(c, x[s : s + 4096]).argmin(1) for s in range(0, len(x), 4096)])
        counts = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(counts)
        c[filled] = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[filled], axis=0) / counts[filled][:, None]
    some = rng.choice(len(raw), min(256, len(raw)), replace=False)

    @F.pandas_udf("int")
    def cell(values: pd.Series) -> pd.Series:
        v = np.stack(values.to_numpy()).astype(np.float64) if len(values) else np.zeros((0, dim))
        return pd.Series(_distances(c, _space(v, metric, scale)).argmin(1).astype("int32"))

    rows = usable.withColumn("cell", cell("values"))
    return InvertedFile(c, scale, _fit_share(x, _query(raw[some], metric, scale), c), metric, rows, rows.groupBy("namespace", "cell").count())
