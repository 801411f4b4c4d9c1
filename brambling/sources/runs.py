"""Harvest runs: sources, works, records, checkpoints and report change together, by one manifest.

A run asks every source for what is new since its checkpoint. A source that fails is reported with its reason, stops no other and
keeps its checkpoint, so that the next run asks for the same again. What the others brought is
written as this run's own files; the manifest that names them, with those of the runs before, is published last.
Readers take the newest manifest: a run that is killed on its way has changed nothing. Of two runs at
once the one that publishes second fails.

Works and records are kept as one delta for each run, merged when they are read; every ``COMPACT`` runs the deltas
become one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.functions import canonical_id
from brambling.operators import merge
from brambling.sources import RECORD, files, state
from brambling.sources.adapters import UnknownAdapter

COMPACT = 8
TYPES = {c: "array<string>" if c == "authors" else "bigint" if c == "citation_count" else "string" for c in RECORD}
WORKS = "work_id string, run bigint, " + ", ".join(f"{c} {t}" for c, t in TYPES.items() if c != "source_id") + ", first_seen_at string, last_seen_at string"
RECORDS = "source string, source_id string, work_id string, run bigint, harvested_at string, raw_json string"
POINTS = "source string, last_success_at string, last_since string"
REPORT = "run bigint, source string, status string, since string, received bigint, new_works bigint, reason string"
SCHEMAS = {"works": WORKS, "records": RECORDS, "checkpoints": POINTS, "report": REPORT}
FILLED = [c for c in TYPES if c not in ("source_id", "oa_status")]


class ConcurrentRun(RuntimeError):
    """Another run has published before this one."""


class HarvestStore:
    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home = spark, home.rstrip("/")

    def version(self) -> int:
        """The number of the newest run that is complete; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.home}/manifests") if n.endswith(".json")), default=0)

    def manifest(self, version: int) -> dict[str, list[str]]:
        return json.loads(files.read(self.spark, f"{self.home}/manifests/{version:08d}.json")) if version else {t: [] for t in SCHEMAS}

    def _held(self, name: str, manifest: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.home}/{p}" for p in manifest[name]]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def works(self, version: int | None = None) -> DataFrame:
        """Works as they were after a run: empty values never win, the status of the newest run does."""
        return _merged_works(self._held("works", self.manifest(self.version() if version is None else version))).drop("run")

    def records(self, version: int | None = None) -> DataFrame:
        return merge.latest_per_key(self._held("records", self.manifest(self.version() if version is None else version)), ["source", "source_id"], F.col("run"))

    def checkpoints(self) -> DataFrame:
        return self._held("checkpoints", self.manifest(self.version()))

    def report(self) -> DataFrame:
        """The newest run's report: a row for every source that was asked, whatever came of it."""
        return self._held("report", self.manifest(self.version()))

    def run(self, sources: dict[str, Callable[[str], DataFrame] | None], today: str, lookback: int = 30, full: list[str] = (), between: Callable[[str], None] = lambda step: None) -> int:
        """One run over sources: functions from ``since`` to records; None where no adapter is known. Gives the run's number.

        Records are normalised ones; those without ``source_id`` count as received and no more. ``between`` is called before each write.
        """
        before = self.version()
        held, number, folder = self.manifest(before), before + 1, f"runs/{uuid.uuid4().hex}"
        points = {r["source"]: r for r in self._held("checkpoints", held).collect()}  # a row for every source
        asked = self.spark.createDataFrame([(s,) for s in sources], "source string")
        known = self._held("checkpoints", held).select("source", "last_since")
        since = {r["source"]: r["since"] for r in state.since(asked, known, F.lit(today).cast("date"), lookback, list(full)).collect()}
        report, staged = [], []
        for name, ask in sources.items():
            path = f"{folder}/staged/{len(report)}"
            try:
                if ask is None:
                    raise UnknownAdapter(f"unknown adapter: {name}")
                rows = ask(since[name])
                rows = rows.select(F.lit(len(report)).alias("place"), F.lit(name).alias("source"), *[F.col(c).cast(t).alias(c) for c, t in TYPES.items()])
                rows.write.parquet(f"{self.home}/{path}")
                received = self.spark.read.parquet(f"{self.home}/{path}").count()
            except Exception as e:  # noqa: BLE001  whatever a source does wrong is its own
                report.append([name, "error", since[name], 0, 0, (str(e) or type(e).__name__).splitlines()[0][:500]])
                continue
            staged.append(path)
            report.append([name, "ok", since[name], received, 0, None])
            points[name] = {"source": name, "last_success_at": today, "last_since": today}
        new = {t: list(held[t]) for t in ("works", "records")} | {"checkpoints": [], "report": []}
        if staged:
            rows = self.spark.read.parquet(*[f"{self.home}/{p}" for p in staged]).filter("coalesce(source_id, '') <> ''")
            rows = rows.withColumn("work_id", canonical_id(F.col("doi"), F.col("arxiv_id"), F.col("source_id"), F.col("title")))
            for r in self._first_of(rows, held).groupBy("source").agg(F.count("*").alias("n")).collect():  # a row for every source
                next(x for x in report if x[0] == r["source"])[4] = r["n"]
            between("works")
            titled = F.when(F.coalesce("title", F.lit("")) == "", "[untitled]").otherwise(F.col("title"))
            works = rows.withColumns({"title": titled, "run": F.lit(number).cast("long"), "first_seen_at": F.lit(today), "last_seen_at": F.lit(today)})
            self._write(_merged_works(works, F.struct("place", "source_id")), f"{folder}/works", "works", new)
            between("records")
            raw = F.to_json(F.struct(*RECORD))
            records = merge.latest_per_key(rows.select("source", "source_id", "work_id", F.lit(number).cast("long").alias("run"), F.lit(today).alias("harvested_at"), raw.alias("raw_json")), ["source", "source_id"], F.col("raw_json"))
            self._write(records, f"{folder}/records", "records", new)
        if number % COMPACT == 0:
            self._compact(new, folder)
        between("checkpoints")
        self._write(self.spark.createDataFrame([(p["source"], p["last_success_at"], p["last_since"]) for p in points.values()], POINTS).coalesce(1), f"{folder}/checkpoints", "checkpoints", new)
        between("report")
        self._write(self.spark.createDataFrame([(number, *r) for r in report], REPORT).coalesce(1), f"{folder}/report", "report", new)
        between("manifest")
        if not files.publish(self.spark, f"{self.home}/manifests/{number:08d}.json", json.dumps(new)):
            raise ConcurrentRun(f"run {number} of {self.home}")
        return number

    def _write(self, rows: DataFrame, path: str, name: str, manifest: dict[str, list[str]]) -> None:
        self.spark.createDataFrame([], SCHEMAS[name]).unionByName(rows.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])).write.parquet(f"{self.home}/{path}")
        manifest[name].append(path)

    def _first_of(self, rows: DataFrame, held: dict[str, list[str]]) -> DataFrame:
        """Works that no run has had, with the first source of this run that brings each."""
        first = rows.groupBy("work_id").agg(F.min_by("source", "place").alias("source"))
        return first.join(self._held("works", held).select("work_id").distinct(), "work_id", "left_anti")

    def _compact(self, manifest: dict[str, list[str]], folder: str) -> None:
        works, records = _merged_works(self._held("works", manifest)), merge.latest_per_key(self._held("records", manifest), ["source", "source_id"], F.col("run"))
        manifest["works"], manifest["records"] = [], []
        self._write(works, f"{folder}/compact-works", "works", manifest)
        self._write(records, f"{folder}/compact-records", "records", manifest)


def _merged_works(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """Of rows or deltas of works, ordered by run (and within one by ``order``), one row for each work."""
    seq = F.col("run") if order is None else F.struct("run", order)
    done = merge.merge_filled(rows, "work_id", seq, FILLED, ["oa_status", "run"], seen=("first_seen_at", "last_seen_at"))
    return done.withColumnsRenamed({"first_seen": "first_seen_at", "last_seen": "last_seen_at"})
