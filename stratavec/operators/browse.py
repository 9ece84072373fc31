"""Reading records without a query: facets, statistics, pages, samples."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratavec.errors import EngineError, invalid
from stratavec.functions.jsonpath import dotted, field_text
from stratavec.functions.metrics import METRICS

_FACET = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")


def facets(records: DataFrame, field: str, limit: int = 20) -> DataFrame:
    """(value, count) of a metadata field, most frequent first and then by value; a missing or null field doesn't count."""
    if not _FACET.match(field) or len(field) > 100:
        raise EngineError("FACET_FIELD_INVALID", "a facet field has letters, digits, _ and dots, 100 at most", field=field)
    if not 1 <= limit <= 100:
        raise invalid("limit must be between 1 and 100")
    values = records.select(field_text(F.col("metadata"), dotted(field)).alias("value")).where(F.col("value").isNotNull())
    return values.groupBy("value").count().orderBy(F.desc("count"), "value").limit(limit)


def namespace_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("namespace").agg(F.count("*").alias("record_count"))


def namespaces(records: DataFrame) -> DataFrame:
    return records.select("namespace").distinct().orderBy("namespace")


def fetch(records: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows of the ids; ids that don't exist are left out, none give none, 1000 at most."""
    if len(ids) > 1000:
        raise invalid("at most 1000 ids")
    return records.where(F.col("id").isin(list(ids)) if ids else F.lit(False))


def fetch_in(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in a table of any size."""
    return records.join(ids.select("id"), "id", "left_semi")


def first_by_id(records: DataFrame, limit: int = 100) -> DataFrame:
    return records.orderBy("id").limit(max(0, min(limit, 1000)))


def list_ids(records: DataFrame, prefix: str = "", after: str | None = None, limit: int = 100) -> DataFrame:
    """Ids with a literal prefix, in order, behind the token."""
    page = records.select("id").where(F.col("id").startswith(prefix))
    if after is not None:
        page = page.where(F.col("id") > after)
    return first_by_id(page, limit)


def scroll(records: DataFrame, cursor: str | None = None, limit: int = 100) -> DataFrame:
    """A page and one row more, in the order of ids, behind the cursor; the row more says that there is a next page."""
    page = records if cursor is None else records.where(F.col("id") > cursor)
    return page.orderBy("id").limit(max(1, min(limit, 1000)) + 1)


def sample(records: DataFrame, size: int = 10, seed: int | None = None) -> DataFrame:
    """Exactly ``size`` random rows (all, if there are fewer), 1 to 1000; with a seed, the same for the same rows."""
    order = F.rand() if seed is None else F.xxhash64(F.lit(seed), "namespace", "id")
    return records.orderBy(order).limit(max(1, min(size, 1000)))


def mean_vector(vectors: DataFrame, values: str = "values") -> DataFrame:
    """One row with the element-wise mean of the vectors; positions are aggregated, not vectors collected."""
    at = vectors.select(F.posexplode(values).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(values))


def recommend_vector(records: DataFrame, positive: Sequence[str], negative: Sequence[str] = ()) -> DataFrame:
    """One row: the mean of the positive ids' vectors minus that of the negative ids'.

    An id counts as often as it is given.  Negative ids that don't exist add nothing but still count in their divisor.
    """
    spark = records.sparkSession
    weights = [(i, 1.0 / len(positive)) for i in positive] + [(i, -1.0 / len(negative)) for i in negative]
    wanted = spark.createDataFrame(weights, "id string, w double").groupBy("id").agg(F.sum("w").alias("w"))
    rows = fetch_in(records, wanted).join(F.broadcast(wanted), "id")  # 100 ids at most
    at = rows.select("w", F.posexplode("values").alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("x"))
    return at.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("values"))


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise invalid(f"metric must be one of: {', '.join(METRICS)}")


def latest(rows: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """The last row of each key: last write wins."""
    w = Window.partitionBy(*key).orderBy(*[F.desc_nulls_first(o) if isinstance(o, str) else o for o in order])
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
