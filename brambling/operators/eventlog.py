"""An event log clustered by scope and id, so that a page or a poll reads only the files it needs.

Each batch is dealt over files by ranges of (scope, event_id) and sorted within them; what every file holds is published
with it: the first and last (scope, event_id), and how many rows. A page after an event takes, from those numbers
alone, the files that can hold its rows, in order, and stops when they hold enough. Batches that overlap in
range are merged every ``COMPACT`` batches; readers hold on to the files they began with.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.sources import files

FILE_ROWS, COMPACT = 1_000_000, 8


class ClusteredLog:
    """Events (``scope`` and ``event_id`` of whole numbers, and other columns) under one folder; a scope's ids don't repeat."""

    def __init__(self, spark: SparkSession, home: str, schema: str, file_rows: int = FILE_ROWS) -> None:
        self.spark, self.home, self.file_rows = spark, home.rstrip("/"), file_rows
        self.schema = spark.createDataFrame([], schema).schema

    def version(self) -> int:
        return max((int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.home}/zones") if n.endswith(".json")), default=0)

    def zones(self) -> list[dict]:
        """What every file holds: file, rows, low and high (scope and id), in order; a row for each file."""
        version = self.version()
        found = json.loads(files.read(self.spark, f"{self.home}/zones/{version:08d}.json")) if version else []
        return sorted(found, key=lambda z: (z["low"], z["high"], z["file"]))

    def append(self, events: DataFrame) -> int:
        """Write a batch and publish it with those before; gives the version. Of two at once the second fails, and can be repeated."""
        version, zones = self.version(), self.zones()
        if (version + 1) % COMPACT == 0 and zones:
            events, zones = events.select(*self.schema.names).unionByName(self._read([z["file"] for z in zones])), []
        zones += self._write(events.select(*self.schema.names))
        if not files.publish(self.spark, f"{self.home}/zones/{version + 1:08d}.json", json.dumps(zones)):
            raise RuntimeError("another batch was published at the same time")
        return version + 1

    def _write(self, rows: DataFrame) -> list[dict]:
        folder = f"rows/{uuid.uuid4().hex}"
        parts = max(1, -(-rows.count() // self.file_rows))
        rows.repartitionByRange(parts, "scope", "event_id").sortWithinPartitions("scope", "event_id").write.parquet(f"{self.home}/{folder}")
        at = F.struct("scope", "event_id")
        held = self.spark.read.schema(self.schema).parquet(f"{self.home}/{folder}").groupBy(F.col("_metadata.file_name").alias("file"))
        return [{"file": f"{folder}/{r['file']}", "rows": r["n"], "low": list(r["low"]), "high": list(r["high"])} for r in held.agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high")).collect()]

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.home}/{n}" for n in names]) if names else self.spark.createDataFrame([], self.schema)

    def files_after(self, scope: int, after: int, limit: int) -> list[str]:
        """The files that hold the next ``limit`` events of a scope after an id; of files that hold others too, or earlier ones, no rows count."""
        found, sure, upto = [], 0, None
        for z in (z for z in self.zones() if z["low"] <= [scope, float("inf")] and z["high"] > [scope, after]):
            if upto is not None and z["low"] > upto:
                break  # what is sure to be there is enough, and all of this file comes later
            found.append(z["file"])
            if z["low"] > [scope, after] and z["high"][0] == z["low"][0] == scope:
                sure += z["rows"]
                if sure >= limit and upto is None:
                    upto = max(x["high"] for x in self.zones() if x["file"] in found)
        return found

    def page(self, scope: int, after: int, limit: int = 100) -> DataFrame:
        """The next events of a scope by id; the last id is the next cursor."""
        limit = max(1, min(limit, 500))
        rows = self._read(self.files_after(scope, after, limit))
        return rows.filter((F.col("scope") == scope) & (F.col("event_id") > after)).orderBy("event_id").limit(limit)

    def read(self) -> DataFrame:
        return self._read([z["file"] for z in self.zones()])
