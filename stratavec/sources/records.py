"""Tables as records: (id, namespace, values, text_content, metadata, created_at, updated_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.functions.jsonpath import valid_json

SCHEMA = "id string, namespace string, values array<float>, text_content string, metadata string, created_at timestamp, updated_at timestamp"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def as_records(df: DataFrame, id: Column, namespace: Column | None = None, values: Column | None = None, text: Column | None = None, metadata: Column | None = None, *extra: Column) -> DataFrame:
    null = F.lit(None)
    return df.select(
        id.cast("string").alias("id"),
        (F.lit("") if namespace is None else F.coalesce(namespace, F.lit(""))).alias("namespace"),
        (null if values is None else values).cast("array<float>").alias("values"),
        (null if text is None else text).cast("string").alias("text_content"),
        (null if metadata is None else metadata).cast("string").alias("metadata"),
        *extra,
    )


def collection(records: DataFrame, name: str) -> DataFrame:
    """The stored records of one collection; metadata that isn't well-formed counts as none."""
    return records.where(F.col("collection_name") == name).select("id", "namespace", "values", "text_content", valid_json(F.col("metadata")).alias("metadata"), "created_at", "updated_at")


def from_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of JSON lines {id, values?, text?, metadata?, namespace?}; metadata keeps its JSON text."""
    raw = spark.read.schema("id string, namespace string, values array<float>, text string, metadata string").json(path)
    return as_records(raw, F.col("id"), F.col("namespace"), F.col("values"), F.col("text"), F.col("metadata"))


def parse_vector(text: Column) -> Column:
    """``[1,2,3]`` as an array; numbers that can't be read are skipped."""
    parts = F.split(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""), ",")
    return F.filter(F.transform(parts, lambda p: F.trim(p).try_cast("float")), lambda x: x.isNotNull())
