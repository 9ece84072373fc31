"""Usable vectors, their exact copies, and k-means for index cells.

Usable: not null, of the asked length, all finite, not all zero.  Vectors travel as raw little-endian 32-bit floats in
a binary column; similarity is the cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavec.session import cut_lineage

#: Numbers of a matrix that is made at once.
STEP = 2_000_000


def usable_vectors(df: DataFrame, columns: list[str], dim: int, values: str = "values") -> DataFrame:
    """``columns`` and ``vec`` of the rows whose vector is usable and whose first column, the key, isn't null; one narrow pass."""
    rows = df.where((F.size(F.col(values)) == dim) & F.col(columns[0]).isNotNull()).select(*columns, F.col(values).cast("array<float>").alias("_values"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", vec binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)  # a null number becomes NaN
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            raw = [r.tobytes() for r in x[good]]
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([*(c.filter(kept) for c in batch.columns[:-1]), pa.array(raw, pa.binary())], names=[*batch.schema.names[:-1], "vec"])

    return rows.mapInArrow(run, schema)


def matrix(vecs, dim: int) -> np.ndarray:
    """The vectors of a column of bytes, in single precision as stored."""
    return np.frombuffer(b"".join(vecs), np.float32).reshape(-1, dim)


def unit(x: np.ndarray, dtype=np.float32) -> np.ndarray:
    """Rows of length 1; the length is taken in double precision, and safely for tiny and huge numbers."""
    out = np.empty(x.shape, dtype)
    for s in steps(*x.shape):
        y = x[s].astype(np.float64)
        y /= np.abs(y).max(axis=1, keepdims=True)
        y /= np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]
        out[s] = y
    return out


def copy_classes(rows: DataFrame, key: str, within: list[str], content: str = "vec") -> DataFrame:
    """(key, rep, n) of the rows whose content is an exact copy of another's in the same ``within`` columns.

    rep is the smallest key of the class.  Hashes of 128 bits are counted with partial aggregation, so a class that
    holds much of the table moves few rows.
    """
    keys = cut_lineage(rows.select(key, *within, F.xxhash64(content).alias("_a"), F.xxhash64(F.lit(1), content).alias("_b")))  # the content is read once
    on = [*within, "_a", "_b"]
    multi = keys.groupBy(*on).agg(F.min(key).alias("rep"), F.count("*").alias("n")).where("n > 1")
    same = [keys[c].eqNullSafe(multi[c]) for c in on]
    return cut_lineage(keys.join(multi, same).select(keys[key], "rep", "n"))


def first_members(classes: DataFrame, key: str, most: int) -> DataFrame:
    """(rep, member): the ``most`` smallest keys of each class."""
    w = Window.partitionBy("rep").orderBy(key)
    return classes.withColumn("_no", F.dense_rank().over(w)).where(F.col("_no") <= most).select("rep", F.col(key).alias("member")).distinct()


def hash_sample(df: DataFrame, key: str | Column, rows: int, of: int, seed: int = 7) -> DataFrame:
    """About ``rows`` of ``of`` rows, chosen by the hash of their key; never more than twice as many."""
    if of <= rows:
        return df.limit(2 * rows)
    share = int(rows / of * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < share).limit(2 * rows)


def steps(rows: int, width: int) -> Iterator[slice]:
    """Slices of ``rows`` rows, of at most 4,096 rows each, and fewer if a row has many numbers in ``width``: a matrix of a slice stays under STEP numbers."""
    size = max(1, min(4096, STEP // max(1, width)))
    return (slice(s, s + size) for s in range(0, rows, size))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 5, spherical: bool = True) -> np.ndarray:
    """Centroids by Lloyd's method from random rows; an empty cell takes the row worst served."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        best, near = np.empty(len(x), np.float32), np.empty(len(x), np.int64)
        half = 0.5 * np.einsum("ij,ij->i", c, c)
        for s in steps(len(x), k):
            score = x[s] @ c.T - half
            near[s] = score.argmax(1)
            best[s] = score.max(1)
        counts = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(counts)
        sums = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[filled], axis=0)
        c[filled] = sums / counts[filled][:, None]
        empty = np.flatnonzero(counts == 0)
        c[empty] = x[np.argsort(best)[: len(empty)]]
        if spherical:
            c /= np.maximum(np.sqrt(np.einsum("ij,ij->i", c, c)), 1e-12)[:, None]
    return c.astype(np.float32)
