"""Similarity of a vector column to a query vector, in double precision.

The score of a metric is higher for closer vectors: cosine in [-1, 1], 1 / (1 + distance), or the product.  A vector
of another length, a null one or one with NaN has no score; nor has the cosine with an all-zero vector.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dotproduct")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    def term(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum(F.zip_with(a, b, term))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def query_vector(vector: Sequence[float]) -> Column:
    """A literal array; single precision, as stored vectors are."""
    return F.lit([float(np.float32(x)) for x in vector])


def score(metric: str, values: Column, query: Column, query_norm: Column | None = None) -> Column:
    """The metric's score of two vector columns."""
    if metric == "dotproduct":
        raw = dot(values, query)
    elif metric == "euclidean":
        raw = 1.0 / (1.0 + F.sqrt(squared_distance(values, query)))
    elif metric == "cosine":
        length = norm(values) * (norm(query) if query_norm is None else query_norm)
        ratio = F.nanvl(dot(values, query) / F.when(length > 0, length), F.lit(None).cast("double"))
        raw = F.when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return F.when(F.size(values) == F.size(query), F.nanvl(raw, F.lit(None).cast("double")))


def score_to(metric: str, values: Column, vector: Sequence[float]) -> Column:
    """The metric's score with a fixed query vector, as an expression of the JVM."""
    length = float(np.linalg.norm(np.asarray(vector, np.float32).astype(np.float64)))
    return score(metric, values, query_vector(vector), F.lit(length))


def arrow_score(metric: str, vector: Sequence[float]):
    """The same as a vectorised function over Arrow batches, for long vectors."""
    q = np.asarray(vector, np.float32).astype(np.float64)

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        fine = values.map(lambda v: v is not None and len(v) == len(q)).to_numpy(bool)
        out = np.full(len(values), np.nan)
        if fine.any():
            x = np.stack(values[fine].to_numpy()).astype(np.float64)
            if metric == "dotproduct":
                out[fine] = x @ q
            elif metric == "euclidean":
                out[fine] = 1.0 / (1.0 + np.sqrt(((x - q) ** 2).sum(1)))
            else:
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[fine] = np.clip(x @ q / (np.sqrt((x * x).sum(1)) * np.sqrt(q @ q)), -1, 1)
        return pd.Series(out).where(~np.isnan(out), None)

    return run
