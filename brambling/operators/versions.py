"""Tables over time: a log of versions with validity intervals, and tables whose schema grows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

from brambling.sources import files


def intervals(writes: DataFrame, key: str = "path", stamp: str = "stamp") -> DataFrame:
    """Every version with the time at which the next one of its key replaces it (``until``; null for the newest)."""
    return writes.withColumn("until", F.lead(stamp).over(Window.partitionBy(key).orderBy(stamp)))


class VersionLog:
    """Writes and deletions (path, stamp, deleted, and the content) by path and time, appended and never changed.

    A write of a path and time that the log has already replaces nothing: of two alike the one that came first counts.
    """

    def __init__(self, spark: SparkSession, home: str, schema: str) -> None:
        self.spark, self.home, self.schema = spark, home.rstrip("/"), schema

    def _numbers(self) -> list[str]:
        return [n for n in files.names(self.spark, f"{self.home}/log") if n.startswith("batch-")]

    def write(self, rows: DataFrame) -> None:
        """Append a batch; it counts once its files are all written."""
        number = len(self._numbers())
        typed = self.spark.createDataFrame([], self.schema)
        rows.select(*typed.columns).withColumn("_batch", F.lit(number)).write.parquet(f"{self.home}/log/batch-{number:08d}")

    def log(self) -> DataFrame:
        """All versions, each path and time once."""
        rows = self.spark.createDataFrame([], f"{self.schema}, _batch int")
        if names := self._numbers():
            rows = self.spark.read.schema(rows.schema).parquet(*[f"{self.home}/log/{n}" for n in names])
        rest = [c for c in rows.columns if c not in ("path", "stamp", "_batch")]
        first = rows.groupBy("path", "stamp").agg(F.min_by(F.struct(*rest), "_batch").alias("_v"))
        return first.select("path", "stamp", *[F.col(f"_v.{c}").alias(c) for c in rest])

    def as_of(self, at: int) -> DataFrame:
        """The files there were at a time: of every path the newest version until then, where that is no deletion."""
        rest = [c for c in self.log().columns if c not in ("path", "stamp")]
        newest = self.log().filter(F.col("stamp") <= at).groupBy("path").agg(F.max_by(F.struct("stamp", *rest), "stamp").alias("_v"))
        return newest.select("path", "_v.*").filter(~F.col("deleted"))

    def restore(self, at: int, now: int) -> None:
        """Bring every path back to what it was at a time, as new versions at ``now``; only those that differ are written."""
        then, current = self.as_of(at), self.as_of(now)
        content = [c for c in then.columns if c not in ("path", "stamp", "deleted")]
        both = then.select("path", F.struct(*content).alias("_then")).join(current.select("path", F.struct(*content).alias("_now")), "path", "full")
        changed = both.filter(~F.col("_then").eqNullSafe(F.col("_now")))
        self.write(changed.select("path", F.lit(now + 1).alias("stamp"), F.col("_then").isNull().alias("deleted"), *[F.col(f"_then.{c}").alias(c) for c in content]))


WIDER = [ShortType(), IntegerType(), LongType()], [FloatType(), DoubleType()]


class EvolvingTable:
    """Batches that each were written under a schema of their time, read through the newest one.

    A schema may add columns, whose default older rows get, and widen whole or floating numbers; anything else is an error.
    """

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home = spark, home.rstrip("/")

    def _schemas(self) -> list[tuple[StructType, dict]]:
        found = [json.loads(files.read(self.spark, f"{self.home}/schemas/{n}")) for n in files.names(self.spark, f"{self.home}/schemas") if n.endswith(".json")]
        return [(StructType.fromJson(x["schema"]), x["defaults"]) for x in found]

    def evolve(self, schema: str, defaults: dict[str, object] | None = None) -> int:
        """Publish the next schema; gives its number."""
        new, have = self.spark.createDataFrame([], schema).schema, self._schemas()
        if have:
            names = {f.name: f.dataType for f in new}
            for f in have[-1][0]:
                if f.name not in names or not _widens(f.dataType, names[f.name]):
                    raise ValueError(f"column {f.name} can't be dropped or made {names.get(f.name)}")
        text = json.dumps({"schema": json.loads(new.json()), "defaults": defaults or {}})
        if not files.publish(self.spark, f"{self.home}/schemas/{len(have):08d}.json", text):
            raise RuntimeError("another schema was published at the same time")
        return len(have)

    def append(self, rows: DataFrame) -> None:
        """Write rows under the newest schema they fit: columns they lack get its default."""
        number = len(self._schemas()) - 1
        schema, defaults = self._schemas()[-1]
        if more := set(rows.columns) - set(schema.names):
            raise ValueError(f"unknown columns: {', '.join(sorted(more))}")
        _through(rows, schema, defaults).write.parquet(f"{self.home}/rows/{number:08d}/{uuid.uuid4().hex}")

    def read(self) -> DataFrame:
        """All rows, through the newest schema."""
        schemas = self._schemas()
        newest, defaults = schemas[-1]
        out = self.spark.createDataFrame([], newest)
        for number, (schema, _) in enumerate(schemas):  # as many as there are schemas
            if names := files.names(self.spark, f"{self.home}/rows/{number:08d}"):
                part = self.spark.read.schema(schema).parquet(*[f"{self.home}/rows/{number:08d}/{n}" for n in names])
                out = out.unionByName(_through(part, newest, defaults))
        return out


def _widens(old, new) -> bool:
    return old == new or any(old in line and new in line and line.index(old) <= line.index(new) for line in WIDER)


def _through(rows: DataFrame, schema: StructType, defaults: dict) -> DataFrame:
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])
