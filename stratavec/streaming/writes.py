"""A stream of writes into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratavec.operators.writes import IN_ORDER, applied, fold
from stratavec.sources.store import KEY, RecordStore


def once(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """A write that is delivered again within the delay counts once; state is kept for that long only."""
    return stream.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["write_id"])


def apply_writes(store: RecordStore, batch: DataFrame) -> None:
    """One micro-batch (write_id, id, namespace, op, values, text_content, set_metadata[, requested_at]): the writes of each key in the
    order of their requests, then of write_id; one commit, so that readers see all of the batch or nothing."""
    order = IN_ORDER if "requested_at" in batch.columns else IN_ORDER[1:]
    folded = fold(batch.withColumn("namespace", F.coalesce("namespace", F.lit(""))), KEY, order)
    store.change(applied(store.read(), folded))


def follow(stream: DataFrame, store: RecordStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the stream into the store until it is stopped; a batch that is repeated after a failure changes nothing more,
    for its writes put whole states of the same keys."""
    return once(stream).writeStream.foreachBatch(lambda df, _: apply_writes(store, df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
