"""Writes as tables: last write wins, whole replacement, shallow merge of metadata, and logs of all of these folded in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavec.functions.jsonpath import merge_metadata, object_entries
from stratavec.operators.browse import latest


def last_wins(batch: DataFrame, order: str = "seq") -> DataFrame:
    """The last write of each (namespace, id)."""
    return latest(batch, ["namespace", "id"], [order])


def upserted(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Full new rows of a deduplicated batch: everything is replaced, but an existing row keeps its creation time."""
    kept = old.select("namespace", "id", F.col("created_at").alias("_created"))
    joined = batch.join(kept, ["namespace", "id"], "left")
    return joined.select("id", "namespace", "values", "text_content", "metadata", F.coalesce("_created", F.current_timestamp()).alias("created_at"), F.current_timestamp().alias("updated_at"))


def updated(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Full new rows of the rows that exist: given values and texts replace, given metadata is merged, key by key.

    changes: (namespace, id, values, text_content, set_metadata), one row a key."""
    new = changes.select("namespace", "id", F.col("values").alias("_values"), F.col("text_content").alias("_text"), "set_metadata")
    joined = old.join(new, ["namespace", "id"])
    return joined.select(
        "id",
        "namespace",
        F.coalesce("_values", "values").alias("values"),
        F.coalesce("_text", "text_content").alias("text_content"),
        merge_metadata("metadata", "set_metadata").alias("metadata"),
        "created_at",
        F.current_timestamp().alias("updated_at"),
    )


def delivered(log: DataFrame) -> DataFrame:
    """A redelivered write counts once, at its first arrival; a null namespace is ''."""
    return latest(log.withColumn("namespace", F.coalesce("namespace", F.lit(""))), ["write_id"], [F.col("received_at").asc_nulls_last()])


def replay(log: DataFrame) -> DataFrame:
    """The last write of each key of a write log, by the time of the request, then by write_id."""
    return latest(delivered(log), ["collection_name", "namespace", "id"], [F.col("requested_at").desc_nulls_last(), F.col("write_id").desc()])


#: The order of the writes of a log.
IN_ORDER = ("requested_at", "write_id")


def fold(log: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """What the writes of each key come to: (key, reset, base, anew, values, text_content, set_metadata), a row a key.

    reset: the last ``upsert`` or ``delete`` of the key, null if there is none; base (values, text_content, metadata): what it holds;
    anew: whether a delete came before.  Then the last values and texts, and the merged metadata, of the updates after it.  Writes
    (op, values, text_content, set_metadata) may be any number a key: only maxima are taken, of each key and each name in its metadata,
    so they combine before they are moved.  An order that is null comes first; metadata of an update that is no JSON object counts
    as none; rows with a null in their key are left out.
    """
    key = list(key)
    kept = log.dropna(subset=key)
    rows = kept.select(*key, "op", "values", "text_content", "set_metadata", F.struct(*order).alias("_at"))
    whole = F.struct("op", "values", "text_content", F.col("set_metadata").alias("metadata"))
    resets = rows.where(F.col("op").isin("upsert", "delete")).groupBy(*key).agg(F.max_by(whole, "_at").alias("base"), F.max("_at").alias("_from"), F.bool_or(F.col("op") == "delete").alias("anew"))
    later = rows.where("op = 'update'").join(resets.select(*key, "_from"), key, "left").where("_from is null or _at > _from").withColumn("_entries", object_entries("set_metadata"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c)
    plain = later.groupBy(*key).agg(last("values"), last("text_content"), F.bool_or(F.col("_entries").isNotNull()).alias("_merges"))
    named = later.select(*key, "_at", F.explode("_entries").alias("e")).groupBy(*key, F.col("e.name").alias("name")).agg(F.max_by("e.value", "_at").alias("value"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda e: F.concat(e["name"], F.lit(":"), e["value"]))
    merged = named.groupBy(*key).agg(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("_merged"))  # a member a name
    out = resets.drop("_from").join(plain.join(merged, key, "left"), key, "full_outer")
    return out.select(*key, F.col("base.op").alias("reset"), "base", F.coalesce("anew", F.lit(False)).alias("anew"), "values", "text_content", F.when(F.col("_merges"), F.coalesce("_merged", F.lit("{}"))).alias("set_metadata"))


def applied(old: DataFrame, folded: DataFrame, key: Sequence[str] = ("namespace", "id")) -> DataFrame:
    """(key, values, text_content, metadata, created_at, updated_at, deleted): the new states of the keys that folded writes change.

    Updates of what doesn't exist, and deletions of it, change nothing."""
    key = list(key)
    stored = old.select(*key, F.struct("values", "text_content", "metadata", "created_at").alias("_old"))
    both = folded.join(stored, key, "left").where("reset = 'upsert' or _old is not null")
    put = F.col("reset") == "upsert"

    def now(c: str) -> Column:
        return F.when(put, F.col("base")[c]).otherwise(F.col("_old")[c])

    both = both.select(
        *key,
        F.coalesce("values", now("values")).alias("values"),
        F.coalesce("text_content", now("text_content")).alias("text_content"),
        now("metadata").alias("_meta"),
        "set_metadata",
        F.coalesce(F.when(~(put & F.col("anew")), F.col("_old.created_at")), F.current_timestamp()).alias("created_at"),
        F.current_timestamp().alias("updated_at"),
        F.coalesce(F.col("reset") == "delete", F.lit(False)).alias("deleted"),
    )
    return both.withColumn("metadata", merge_metadata("_meta", "set_metadata")).drop("_meta", "set_metadata")
