"""Connected components of an edge table, without ever bringing it to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame, u: str, v: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of an edge and the smallest node it is connected with.

    Large-star and small-star rounds: every node hangs its larger neighbours, then its smaller ones, on the
    smallest node it sees, until only stars are left.  The number of rounds grows with the logarithm of the longest
    path; each round's edges are no more than the input's and are checkpointed.  Edges with a null end, loops and
    repeated edges don't matter; nodes without another node have no row.
    """
    # an edge is (u, v) with u > v
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v")))
    now = cut_lineage(now.distinct())
    before = None
    for _ in range(most_rounds):
        state = _state(now)
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut_lineage(small)
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
