"""Versioned storage of a collection's records.

A version is a manifest: a base folder and the deltas since.  A delta holds the last state of each key it touches, or its
deletion.  A write adds a delta and then creates the next manifest, which only one writer can; so readers see whole versions, no file
that is read is ever overwritten, and a write costs what it touches.  The version is that of the last manifest.  ``compact`` writes a new
base, ordered by namespace and id so that Parquet statistics prune namespaces; a write that leaves more than MOST_DELTAS does so too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavec.operators.browse import latest
from stratavec.sources.files import Folder
from stratavec.sources.records import SCHEMA

#: Deltas that are read beside the base.
MOST_DELTAS = 16
KEY = ["namespace", "id"]
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class RecordStore:
    def __init__(self, spark: SparkSession, root: Folder):
        self.spark, self.root = spark, root

    def manifest(self) -> dict:
        names = self.root.names("manifest-")
        return self.root.read(names[-1]) if names else {"version": 0, "base": None, "deltas": []}

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root.uri}/{name}")

    def read(self) -> DataFrame:
        """The current records."""
        m = self.manifest()
        base = self._read(m["base"], SCHEMA) if m["base"] else self.spark.createDataFrame([], SCHEMA)
        if not m["deltas"]:
            return base
        deltas = [self._read(d, f"{SCHEMA}, deleted boolean").withColumn("_seq", F.lit(k)) for k, d in enumerate(m["deltas"])]
        every = deltas[0]
        for d in deltas[1:]:
            every = every.unionByName(d)
        last = latest(every, KEY, ["_seq"])
        return base.join(last.select(*KEY), KEY, "left_anti").select(*COLUMNS).unionByName(last.where("not deleted").select(*COLUMNS))

    def _commit(self, m: dict, **changes) -> dict:
        new = {**m, **changes, "version": m["version"] + 1}
        if not self.root.create(f"manifest-{new['version']:012d}.json", new, self.spark):
            raise RuntimeError("the collection was changed by another writer")
        return new

    def put(self, rows: DataFrame) -> None:
        """Insert or replace whole rows; keys must be unique in ``rows``."""
        self._add(rows.withColumn("deleted", F.lit(False)))

    def remove(self, keys: DataFrame) -> None:
        nulls = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", ")) if c not in KEY]
        self._add(keys.select(*KEY).distinct().select(*KEY, *nulls).withColumn("deleted", F.lit(True)))

    def _add(self, delta: DataFrame) -> None:
        m = self.manifest()
        name = f"delta-{uuid.uuid4().hex}"
        delta.select(*COLUMNS, "deleted").write.parquet(f"{self.root.uri}/{name}")
        if len(self._commit(m, deltas=[*m["deltas"], name])["deltas"]) > MOST_DELTAS:
            self.compact()

    def change(self, rows: DataFrame) -> None:
        """Insert, replace and delete in one commit: whole rows with ``deleted``; keys must be unique."""
        self._add(rows)

    def compact(self) -> None:
        m = self.manifest()
        name = f"base-{uuid.uuid4().hex}"
        self.read().repartitionByRange("namespace", "id").sortWithinPartitions("namespace", "id").write.parquet(f"{self.root.uri}/{name}")
        self._commit(m, base=name, deltas=[])

    def drop(self) -> None:
        self.root.delete()
