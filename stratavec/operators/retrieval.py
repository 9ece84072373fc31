"""Top-k by vector, by keywords, and by both.

Sources return (rank, id, namespace, score, ...): rank 1 is best, equal scores go by id.  Each top-k is taken with
``orderBy.limit`` (a partial top-k per partition), and ranks are given only to what is left, so no window ever sees
more than the pool.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.functions.metrics import score, score_to
from stratavec.functions.text import keyword_terms

#: Scores are ranked after rounding: sums of the same numbers in another order are equal then.
DIGITS = 12
#: Keyword ranking, as Okapi BM25 has them; fusion by reciprocal ranks, and its pool.
K1, B = 1.2, 0.75
RRF_K, POOL_FACTOR, MOST = 60, 6, 10_000
#: Queries of a batch that are broadcast; more are an error, to be asked in several batches.
MOST_QUERIES = 1000


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = [F.desc_nulls_last(F.round("score", DIGITS)), F.col("id"), F.col("namespace")]
    best = scored.orderBy(*order).limit(max(0, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def dense(records: DataFrame, vector: Sequence[float], metric: str, k: int, expression: Column | None = None) -> DataFrame:
    """The k best by a metric; rows whose vector is null or has another length don't count, unscored ones come last."""
    usable = records.where(F.size("values") == len(vector))
    return _top(usable.withColumn("score", score_to(metric, F.col("values"), vector) if expression is None else expression), k)


def batch(records: DataFrame, queries: DataFrame, metric: str, k: int) -> DataFrame:
    """The k best of each query (query_id, query); queries are broadcast, so their number is checked.

    Ranking by query keeps k rows a partition before the exchange.
    """
    q = queries.select("query_id", F.col("query"))
    if (n := q.count()) > MOST_QUERIES:
        raise ValueError(f"{n} queries; a batch has {MOST_QUERIES} at most")
    scored = records.crossJoin(F.broadcast(q)).where(F.size("values") == F.size("query")).withColumn("score", score(metric, F.col("values"), F.col("query"))).drop("query")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("score", DIGITS)), "id", "namespace")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- keywords


def query_terms(text: str) -> list[str]:
    import re

    return sorted({t for t in re.split(r"[^a-z0-9]+", text.lower()) if t})


def build_postings(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keyword index: postings (term, id, namespace, tf, dl) and, in one row, (n_docs, avgdl).

    Written partitioned or bucketed by term, a query reads its terms' rows only.
    """
    docs = records.where(F.col("text_content").isNotNull()).select("id", "namespace", keyword_terms("text_content").alias("terms"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("terms")).alias("avgdl"))
    postings = docs.select("id", "namespace", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("term", "id", "namespace").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return postings, stats


def write_postings(records: DataFrame, folder: str) -> None:
    """The keyword index as files, in the order of terms, so that a query's terms are found by the files' statistics."""
    postings, stats = build_postings(records)
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    stats.write.mode("overwrite").parquet(f"{folder}/stats")


def read_postings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    postings = "term string, id string, namespace string, tf long, dl int"
    return spark.read.schema(postings).parquet(f"{folder}/postings"), spark.read.schema("n_docs long, avgdl double").parquet(f"{folder}/stats")


def _postings_scores(postings: DataFrame, stats: DataFrame, text: str) -> DataFrame:
    """(id, namespace, score) of all documents with one of the query's different terms; only their terms' rows are read."""
    mine = postings.where(F.col("term").isin(query_terms(text)))
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    one = mine.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row a query term; one row
    part = _idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return one.groupBy("id", "namespace").agg(F.round(F.sum(part), DIGITS).alias("score"))


def bm25_postings(postings: DataFrame, stats: DataFrame, text: str, k: int, records: DataFrame | None = None, matching: Column | None = None) -> DataFrame:
    """The k best of an index.  With the records it is of, the rows have their columns, and ``matching`` says which may be found."""
    scored = _postings_scores(postings, stats, text)
    if matching is not None:
        scored = scored.join(records.where(matching).select("id", "namespace"), ["id", "namespace"], "left_semi")
    best = _top(scored, k)
    return best if records is None else records.join(F.broadcast(best), ["id", "namespace"])  # MOST rows at most


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25(records: DataFrame, text: str, k: int, matching: Column | None = None) -> DataFrame:
    """The k best by keywords without an index: one aggregate for the statistics, one pass for the scores.

    Statistics are those of the whole collection; ``matching`` then says which rows may be found.  Rows without any of
    the terms don't count; a query without terms finds nothing.
    """
    terms = query_terms(text)
    if not terms:
        return _top(records.where(F.lit(False)).withColumn("score", F.lit(0.0)), 0)
    tfs, dfs = [f"_tf{i}" for i in range(len(terms))], [f"_df{i}" for i in range(len(terms))]
    docs = records.where(F.col("text_content").isNotNull()).withColumn("_terms", keyword_terms("text_content")).withColumn("_dl", F.size("_terms"))
    # what is gone when a term is removed is its frequency; unlike a lambda, this is compiled
    docs = docs.withColumns({c: F.col("_dl") - F.size(F.array_remove("_terms", t)) for c, t in zip(tfs, terms)}).drop("_terms")
    stats = docs.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"), *[F.count_if(F.col(t) > 0).alias(d) for t, d in zip(tfs, dfs)])
    found = docs.where(reduce(Column.__or__, [F.col(t) > 0 for t in tfs]))
    if matching is not None:
        found = found.where(matching)
    scored = found.crossJoin(F.broadcast(stats))  # one row
    norm = K1 * (1 - B + B * F.col("_dl") / F.col("_avgdl"))
    parts = [F.when(F.col(t) > 0, _idf(F.col("_n"), F.col(d)) * F.col(t) * (K1 + 1) / (F.col(t) + norm)).otherwise(0.0) for t, d in zip(tfs, dfs)]
    return _top(scored.withColumn("score", reduce(Column.__add__, parts)).drop("_dl", "_n", "_avgdl", *tfs, *dfs), k)


# ---------------------------------------------------------------- both


def pool_size(k: int) -> int:
    return min(POOL_FACTOR * k, MOST)


def fuse(dense_leg: DataFrame, keyword_leg: DataFrame, k: int, alpha: float = 0.5, bm25_weight: float | None = None) -> DataFrame:
    """Weighted reciprocal ranks of two legs; a row that a leg lacks gets nothing from it."""
    alpha = min(1.0, max(0.0, alpha))
    other = 1.0 - alpha if bm25_weight is None else bm25_weight
    columns = [c for c in dense_leg.columns if c not in ("id", "namespace", "rank", "score")]
    left = dense_leg.select("id", "namespace", F.col("rank").alias("_dense"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    right = keyword_leg.select("id", "namespace", F.col("rank").alias("_words"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    both = left.join(right, ["id", "namespace"], "full_outer")
    part = lambda rank, weight: F.coalesce(F.lit(float(weight)) / (F.lit(float(RRF_K)) + F.col(rank)), F.lit(0.0))
    kept = [F.coalesce(f"_l_{c}", f"_r_{c}").alias(c) for c in columns]
    return _top(both.select("id", "namespace", *kept, (part("_dense", alpha) + part("_words", other)).alias("score")), k)


def hybrid(records: DataFrame, vector: Sequence[float], text: str, metric: str, k: int, matching: Column | None = None, alpha: float = 0.5, bm25_weight: float | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Fused top-k; index: postings and statistics of the records, where they were built."""
    pool = pool_size(k)
    mine = records if matching is None else records.where(matching)
    words = bm25(records, text, pool, matching) if index is None else bm25_postings(*index, text, pool, records, matching)
    return fuse(dense(mine, vector, metric, pool), words, k, alpha, bm25_weight)
