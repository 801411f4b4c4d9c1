"""Collections of vectors: builds, swaps, access by level and scope, private stores, rendered results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How high a key's level stands, and which collections it may search.
LEVELS = {"admin": 5, "ingest": 4, "research": 3, "langbot": 2, "public": 1}
ACCESS = {"admin": ["public", "novel", "data"], "research": ["public", "data"], "langbot": ["public", "novel"], "public": ["public"], "ingest": []}
PERSONAL = ("public", "data", "private")


def access_table(spark: SparkSession) -> DataFrame:
    """level, collection: a row for every pair that is allowed."""
    return spark.createDataFrame([(level, c) for level, cs in ACCESS.items() for c in cs], "level string, collection string")


def reaches(level: Column, required: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), level), F.lit(0)) >= LEVELS[required]


def in_scope(scope: Column, collection: Column) -> Column:
    """Whether a personal token may search a collection."""
    return collection.isin(*PERSONAL) & F.array_contains(scope, F.concat(collection, F.lit(":search")))


class CollectionNotBuilt(LookupError):
    pass


class Store:
    """Builds of collections under one folder; a build of a private collection belongs to an owner.

    A build's rows are written first and named by a row of ``current`` afterwards: readers see the build
    before or the one after, never a part. An older build stays on disk for readers that began with it.
    """

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home = spark, home.rstrip("/")

    def _point(self, collection: str, owner: str, build: str | None, number: int) -> None:
        row = [(collection, owner, build, number)]
        self.spark.createDataFrame(row, "collection string, owner string, build string, number long").coalesce(1).write.mode("append").parquet(f"{self.home}/current")

    def current(self) -> DataFrame:
        """collection, owner, build (null if removed) of the newest row of each; one for each collection and user."""
        try:
            rows = self.spark.read.parquet(f"{self.home}/current")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "collection string, owner string, build string, number long")
        return rows.groupBy("collection", "owner").agg(F.max_by(F.struct("build", "number"), "number").alias("c")).select("collection", "owner", "c.build", "c.number")

    def _build_of(self, collection: str, owner: str) -> tuple[str | None, int]:
        r = self.current().filter((F.col("collection") == collection) & (F.col("owner") == owner)).first()
        return (r["build"], r["number"]) if r else (None, 0)

    def rebuild(self, collection: str, rows: DataFrame, owner: str = "") -> bool:
        """Replace a collection by rows. Without rows a shared collection keeps its last build, and a user's is removed."""
        build, (_, number) = f"{self.home}/builds/{uuid.uuid4().hex}", self._build_of(collection, owner)
        rows.write.parquet(build)
        there = bool(self.spark.read.schema(rows.schema).parquet(build).limit(1).count())
        if there or owner:
            self._point(collection, owner, build if there else None, number + 1)
        return there

    def read(self, collection: str, owner: str = "") -> DataFrame | None:
        """The rows of a collection; a shared one that was never built is an error, a user's is None."""
        build, _ = self._build_of(collection, owner)
        if build is None:
            if owner:
                return None
            raise CollectionNotBuilt(collection)
        return self.spark.read.parquet(build)


def allowed_rows(requests: DataFrame, rows: DataFrame, access: DataFrame) -> DataFrame:
    """Every request (request_id, level) with the rows of the collections that its level may read."""
    return requests.join(access, "level").join(rows, "collection")


def percent(x: Column) -> Column:
    """Whole percents, halves to the even one."""
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def rendered(results: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked results of every key as the text of a tool's answer."""
    each = F.concat(F.lit("--- "), F.col("rank").cast("string"), F.lit(" ("), percent(F.col("similarity")), F.lit(") ---\n"), "source", F.lit("\n"), "content", F.lit("\n"))
    parts = results.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", each.alias("t")))).alias("p"))
    return parts.select(*keys, F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))


def with_context(messages: DataFrame, results: DataFrame, key: str, most: int = 300) -> DataFrame:
    """Messages with what was found for them added; blank ones, commands and ones without results stay as they are."""
    each = F.concat(F.lit("["), percent(F.col("similarity")), F.lit("] "), "source", F.lit("\n"), F.left("content", F.lit(most)))
    parts = results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", each.alias("t")))).alias("p"))
    asked = F.trim("text")
    plain = (asked == "") | asked.startswith("/")
    joined = messages.join(parts, key, "left")
    text = F.when(plain | F.col("p").isNull(), F.col("text")).otherwise(F.concat(asked, F.lit("\n\nFound documents:\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n")))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in messages.columns], (~plain & F.col("p").isNotNull()).alias("enhanced"))
