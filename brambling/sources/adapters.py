"""Recorded pages of harvest sources as a data source, and the registry of adapters by name.

A recording is a folder for each source: ``pages/page=K`` with the items of a page as JSON lines, and ``index`` with
what each page holds (page, items, low, high of the items' ``updated``). Format ``recorded_pages`` reads one: a filter on
``updated`` and the option ``limit`` reach the reader, which leaves out the pages that end before it, and those beyond
the limit; pages are dealt over tasks. An adapter is the shape of a source's items and how they become
records; sources are found by name, and others can be registered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from brambling.sources.uploads import file_system

TASKS = 64
#: Added to each item: its page, and how many pages the reader chose.
EXTRA = "updated string, _page int, _pages int"


@dataclass(frozen=True)
class Adapter:
    """A source's name, its items as a schema, and the function from items to records."""

    name: str
    items: str
    normalise: Callable[[DataFrame], DataFrame]


class UnknownAdapter(LookupError):
    pass


ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    """Adds an adapter, or replaces the one of its name."""
    ADAPTERS[adapter.name] = adapter
    return adapter


def adapter(name: str) -> Adapter:
    if name not in ADAPTERS:
        raise UnknownAdapter(name)
    return ADAPTERS[name]


def record(items: DataFrame, home: str, source: str, page: str = "page") -> None:
    """Record items (with ``updated`` and a column of page numbers) as a source's pages."""
    items.withColumn("page", F.col(page).cast("int")).repartition("page").write.mode("overwrite").partitionBy("page").json(f"{home}/{source}/pages")
    pages = items.groupBy(F.col(page).cast("int").alias("page")).agg(F.count("*").alias("items"), F.min("updated").alias("low"), F.max("updated").alias("high"))
    pages.coalesce(1).write.mode("overwrite").json(f"{home}/{source}/index")


@dataclass
class _Pages(InputPartition):
    pages: list[int]
    planned: int


class RecordedReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]) -> None:
        self.names = schema.names
        self.home = f"{options['path'].rstrip('/')}/{options['source']}"
        self.limit = int(options["limit"]) if "limit" in options else None
        self.since, self.page = "", None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Pages are chosen by these; rows are still filtered by Spark, as a page may begin before."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("updated",) and isinstance(f.value, str):
                self.since = max(self.since, f.value)
            if isinstance(f, EqualTo) and f.attribute == ("_page",):
                self.page = f.value
            yield f

    def _lines(self, folder: str) -> Iterator[dict]:
        from pyarrow.fs import FileSelector

        fs, home = file_system(self.home)
        for info in sorted(fs.get_file_info(FileSelector(f"{home}/{folder}", allow_not_found=True)), key=lambda x: x.path):
            if info.path.endswith(".json"):
                with fs.open_input_stream(info.path) as file:
                    yield from map(json.loads, filter(None, file.read().decode().split("\n")))

    def partitions(self) -> list[InputPartition]:
        pages = sorted((p for p in self._lines("index") if p["high"] >= self.since and self.page in (None, p["page"])), key=lambda p: (p["low"], p["page"]))
        if self.limit is not None:  # the first page may hold items before ``since``: it counts for none
            held, upto = 0, 0
            for k, p in enumerate(pages):
                if held >= self.limit:
                    break
                held, upto = held + p["items"] * (p["low"] >= self.since), k + 1
            pages = pages[:upto]
        tasks = min(TASKS, len(pages)) or 1
        return [_Pages([p["page"] for p in pages[k::tasks]], len(pages)) for k in range(tasks)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        for page in partition.pages:
            for item in self._lines(f"pages/page={page}"):
                item |= {"_page": page, "_pages": partition.planned}
                yield tuple(item.get(c) for c in self.names)


class RecordedPages(DataSource):
    """Options: path (of the recording), source (its name in the registry), limit (items that are wanted)."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return f"{adapter(self.options['source']).items}, {EXTRA}"

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(schema, dict(self.options))


def items_of(spark: SparkSession, home: str, source: str, limit: int | None = None) -> DataFrame:
    """A source's recorded items; filter on ``updated`` to leave out pages."""
    spark.dataSource.register(RecordedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # read when a plan is made; it stays set
    rows = spark.read.format("recorded_pages").schema(f"{adapter(source).items}, {EXTRA}").option("path", home).option("source", source)
    return (rows if limit is None else rows.option("limit", str(limit))).load()


def collect(spark: SparkSession, home: str, source: str, since: str, limit: int | None = None) -> DataFrame:
    """The records of a source from a day on, the oldest ``limit`` of them."""
    rows = items_of(spark, home, source, limit).filter(F.col("updated") >= since)
    if limit is not None:
        rows = rows.orderBy("updated", "_page").limit(limit)
    return adapter(source).normalise(rows)
