"""Incremental runs: paging by event id, merging micro-batches into a table, checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brambling.sources.cursor import CursorSource


def page(events: DataFrame, after: int, limit: int = 100) -> DataFrame:
    """The next events by id; the last id is the next cursor."""
    return events.filter(F.col("event_id") > after).orderBy("event_id").limit(max(1, min(limit, 500)))


BUCKETS = 16


def _held(spark: SparkSession, target: str, before: int, buckets: list[int] | None, schema) -> DataFrame | None:
    """The rows of the table as it was before a batch, of some buckets or of all: of every bucket its newest version."""
    if not before:
        return None
    versions = spark.read.parquet(*[f"{target}/manifest/{n}" for n in range(before)]).groupBy("bucket").agg(F.max("version").alias("version"))
    paths = [f"{target}/rows/{r['version']}/_bucket={r['bucket']}" for r in versions.collect() if buckets is None or r["bucket"] in buckets]  # a row for every bucket
    return spark.read.schema(schema).parquet(*paths) if paths else None


def merge_stream(stream: DataFrame, target: str, checkpoint: str, merge: Callable[[DataFrame], DataFrame], keys: list[str], every: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Every micro-batch is merged with what the table holds of its keys, and only their buckets are written anew.

    A bucket's version is written first and named in the batch's manifest afterwards. A batch that runs
    again begins from the manifests before it and rewrites its own: a restart neither loses nor repeats
    rows. ``merge`` keeps the columns of its input. ``every`` polls at an interval; without it the query
    ends when all that is there has been read, or is stopped once it has (``merged``) where a source can't end.
    """
    schema = stream.schema

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = batch.withColumn("_bucket", bucket).persist()
        touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]
        held = _held(spark, target, number, touched, schema)
        rows = new.drop("_bucket") if held is None else new.drop("_bucket").unionByName(held)
        merge(rows).select(*schema.names).withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/rows/{number}")
        spark.createDataFrame([(b, number) for b in touched], "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/{number}")
        new.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def cursor_stream(spark: SparkSession, path: str, cursor: str, after: int = 0, size: int = 1000, columns: dict[str, str] | None = None) -> DataFrame:
    """A log polled by its cursor: the cursor's column and others by type, ``size`` ids a micro-batch."""
    spark.dataSource.register(CursorSource)
    schema = ", ".join(f"`{c}` {t}" for c, t in ({cursor: "bigint"} | (columns or {})).items())
    return spark.readStream.format("cursor_log").schema(schema).options(path=path, cursor=cursor, after=after, size=size).load()


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, one file a micro-batch."""
    path = f"{sf_dir.rstrip('/')}/{name}.parque"
    return spark.readStream.schema(spark.read.parquet(path + "t").schema).option("maxFilesPerTrigger", 1).parquet(path + "[t]")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the cluster names; a local one only where none is set and all runs on one machine."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "brambling-scratch")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def merged(stream: DataFrame, merge: Callable[[DataFrame], DataFrame], keys: list[str], every: str | None = None) -> DataFrame:
    """What the merged table holds after all that the stream has now; no rows where it has none."""
    spark, home = stream.sparkSession, scratch(stream.sparkSession, "merged")
    query = merge_stream(stream, f"{home}/table", f"{home}/checkpoint", merge, keys, every)
    if every:
        query.processAllAvailable()
        query.stop()
    else:
        query.awaitTermination()
    if query.exception():
        raise query.exception()
    last = max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=-1)
    held = _held(spark, f"{home}/table", last + 1, None, stream.schema)
    return spark.createDataFrame([], stream.schema) if held is None else held
