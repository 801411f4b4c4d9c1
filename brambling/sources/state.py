"""State of a harvest: merged works, records of their sources, checkpoints, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.functions.checks import days_before
from brambling.operators import merge

#: Columns of which a new value wins only if it isn't empty; the status wins always, the count if it isn't null.
FILLED = ["doi", "arxiv_id", "title", "abstract", "authors", "published", "landing_url", "oa_url", "work_type", "updated", "citation_count"]
BEGINNING = "1800-01-01"


def merge_works(records: DataFrame, seq: Column) -> DataFrame:
    """Works of all their records (work_id, harvested_at, ...): first_seen_at stays, last_seen_at is replaced."""
    done = merge.merge_filled(records, "work_id", seq, [c for c in FILLED if c in records.columns], ["oa_status"] if "oa_status" in records.columns else [], seen="harvested_at")
    return done.withColumnsRenamed({"first_seen": "first_seen_at", "last_seen": "last_seen_at"})


def merge_source_records(records: DataFrame) -> DataFrame:
    """The newest record of every source and source_id, which says the work it belongs to now."""
    return merge.latest_per_key(records.filter("coalesce(source_id, '') <> ''"), ["source", "source_id"], F.col("harvested_at"))


def checkpoints(runs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """source, last_since after runs (source, status, seq, day): only a run that went well moves a source on."""
    new = runs.filter("status = 'ok'").groupBy("source").agg(F.max_by("day", "seq").alias("last_since"))
    if before is None:
        return new
    kept = before.join(new, "source", "left_anti")
    return kept.select("source", "last_since").union(new)


def since(sources: DataFrame, points: DataFrame, today: Column, lookback: int, full: list[str] = ()) -> DataFrame:
    """source, since: the beginning for a full run, else the checkpoint, else ``lookback`` days before today."""
    start = F.when(F.col("source").isin(*full), BEGINNING) if full else F.lit(None).cast("string")
    return sources.join(points, "source", "left").select("source", F.coalesce(start, "last_since", days_before(today, lookback)).alias("since"))


def report(records: DataFrame, works: DataFrame, seq: Column, asked: DataFrame | None = None) -> DataFrame:
    """A row for every source: status, received, new_works. A work is new where no table has it and no earlier record of the run brought it.

    ``asked`` (source, status, since, reason) are the sources of the run: those that failed or brought nothing have a row too.
    """
    first = records.groupBy("work_id").agg(F.min_by("source", seq).alias("source")).join(works.select("work_id").distinct(), "work_id", "left_anti")
    new = first.groupBy("source").agg(F.count("*").alias("new_works"))
    received = records.groupBy("source").agg(F.count("*").alias("received"))
    if asked is not None:
        rows = asked.join(received, "source", "left").join(new, "source", "left")
        return rows.select("source", "status", "since", F.coalesce("received", F.lit(0)).alias("received"), F.coalesce("new_works", F.lit(0)).alias("new_works"), "reason")
    return received.join(new, "source", "left").select("source", F.lit("ok").alias("status"), "received", F.coalesce("new_works", F.lit(0)).alias("new_works"))


def write_report(rows: DataFrame, path: str) -> None:
    """The latest report, one JSON row for every source."""
    rows.withColumn("generated_at", F.current_timestamp().cast("string")).coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
