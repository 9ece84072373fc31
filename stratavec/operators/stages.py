"""What happens to ranked matches, in this order: rerank, threshold, deduplicate, group, truncate.

All stages take and give (rank, id, score, metadata, ...); ranks start at 1 and say the order.  Matches are at most a pool
of 10,000 rows, so their windows are small.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavec.errors import EngineError
from stratavec.functions.jsonpath import field_key, field_text


def _ranked(matches: DataFrame, *order) -> DataFrame:
    return matches.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rerank(matches: DataFrame, reranker, query: str, top_n: int, rank_field: str = "text", model: str | None = None) -> DataFrame:
    """Scores are replaced by the reranker's; its best ``top_n`` stay.

    The text of a match is its metadata's ``rank_field`` (if a string), else ``text``, else its id.  Candidates go to
    the reranker together, in the order of their ranks.
    """
    own = F.coalesce(_string_field(rank_field), _string_field("text"), F.col("id"))
    ready = matches.withColumn("_text", own).coalesce(1).sortWithinPartitions("rank")
    schema = matches.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [b for b in batches if len(b)]
        if every:
            pdf = pd.concat(every, ignore_index=True)
            scores = reranker.scores(query, list(pdf.pop("_text")), list(pdf["score"]), model)
            pdf["score"] = [float(s) for s in scores]
            yield pdf

    scored = ready.mapInPandas(run, schema)
    return _ranked(scored, F.desc("score"), F.col("rank")).where(F.col("rank") <= top_n)


def _string_field(name: str):
    from stratavec.functions.jsonpath import field_variant

    return F.when(F.schema_of_variant(field_variant(F.col("metadata"), [name])) == "STRING", field_text(F.col("metadata"), [name]))


def threshold(matches: DataFrame, least: float) -> DataFrame:
    """Scores of at least ``least``."""
    return matches.where(F.col("score") >= least)


def dedup(matches: DataFrame, by: str) -> DataFrame:
    """The first match of each value of a top-level field; matches without the field all stay."""
    w = Window.partitionBy("_key").orderBy("rank")
    keyed = matches.withColumn("_key", field_key(F.col("metadata"), by)).withColumn("_nth", F.row_number().over(w))
    kept = keyed.where(F.col("_key").isNull() | (F.col("_nth") == 1)).drop("_key", "_nth")
    return _ranked(kept, F.col("rank"))


def group_by(matches: DataFrame, field: str, limit: int = 10, group_size: int = 3) -> DataFrame:
    """(group_rank, key, member_rank, ...): groups in the order of their best match, their best members in order.

    A missing field groups under the empty key, JSON null under ``null``.
    """
    key = F.coalesce(field_key(F.col("metadata"), field), F.lit(""))
    w = Window.partitionBy("key")
    keyed = matches.withColumn("key", key).withColumn("_first", F.min("rank").over(w)).withColumn("member_rank", F.row_number().over(w.orderBy("rank")))
    ranked = keyed.where(F.col("member_rank") <= group_size).withColumn("group_rank", F.dense_rank().over(Window.orderBy("_first")))
    return ranked.where(F.col("group_rank") <= limit).drop("_first", "rank")


def require_field(matches: DataFrame, field: str) -> None:
    """GROUPBY_FIELD_MISSING if there are matches and none has the field; one small action."""
    n, having = matches.agg(F.count("*"), F.count(field_key(F.col("metadata"), field))).first()
    if n and not having:
        raise EngineError("GROUPBY_FIELD_MISSING", f"no match has the field {field!r}", field=field)


def truncate(matches: DataFrame, k: int) -> DataFrame:
    return matches.where(F.col("rank") <= k)
