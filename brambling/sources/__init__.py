"""Table and file sources, and the normalisers that bring harvested records to one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.functions import clean_doi, last_segment

RECORD = ["source_id", "doi", "arxiv_id", "title", "abstract", "authors", "published", "landing_url", "oa_status", "oa_url", "work_type", "updated", "citation_count"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_files(spark: SparkSession, folder: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """path and content of every text file under a folder; unreadable ones are skipped."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").option("wholetext", "true")
    return read.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the files of one folder, sorted; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select(last_segment(F.col("path")).alias("name"), "length").orderBy("name")


def abstract_from_index(index: Column) -> Column:
    """The text of a map from token to positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("place"), e["key"].alias("token")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["token"]), " ")


def dashed_date(parts: Column) -> Column:
    """Year, month and day as they come, not zero-padded: don't compare such dates as text."""
    return F.array_join(F.transform(parts, lambda x: x.cast("string")), "-")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _filled(*columns: Column) -> Column:
    """The first value that isn't null or empty, else empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def normalise_crossref(items: DataFrame) -> DataFrame:
    """Items of a Crossref response, in its own shape, as records: a work is known by its cleaned DOI."""
    author = lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit("")))
    doi = clean_doi(F.col("DOI"))
    return items.select(
        doi.alias("source_id"), doi.alias("doi"), F.lit("").alias("arxiv_id"),
        _text(F.get("title", F.lit(0))).alias("title"), _text(F.col("abstract")).alias("abstract"),
        F.coalesce(F.filter(F.transform("author", author), lambda a: a != ""), F.array().cast("array<string>")).alias("authors"),
        _text(dashed_date(F.get("published.`date-parts`", F.lit(0)))).alias("published"),
        _filled(F.col("URL"), F.concat(F.lit("https://doi.org/"), doi)).alias("landing_url"), F.lit("unknown").alias("oa_status"), F.lit("").alias("oa_url"),
        _text(F.col("type")).alias("work_type"), _text(F.col("indexed.`date-time`")).alias("updated"), F.col("`is-referenced-by-count`").cast("long").alias("citation_count"),
    )


def normalise_openalex(works: DataFrame) -> DataFrame:
    """Works of an OpenAlex response, in its own shape, as records."""
    name = lambda a: a["author"]["display_name"]
    return works.select(
        _text(last_segment(F.col("id"))).alias("source_id"), clean_doi(F.col("doi")).alias("doi"), _text(last_segment(F.col("ids.arxiv"))).alias("arxiv_id"),
        _text(F.col("title")).alias("title"), _text(abstract_from_index(F.col("abstract_inverted_index"))).alias("abstract"),
        F.coalesce(F.filter(F.transform("authorships", name), lambda a: _text(a) != ""), F.array().cast("array<string>")).alias("authors"), _text(F.col("publication_date")).alias("published"),
        _filled(F.col("primary_location.landing_page_url"), F.col("doi"), F.col("id")).alias("landing_url"),
        F.when(F.col("open_access.is_oa"), "open").otherwise("closed_or_unknown").alias("oa_status"), _text(F.col("open_access.oa_url")).alias("oa_url"),
        _text(F.col("type")).alias("work_type"), _text(F.col("updated_date")).alias("updated"), F.col("cited_by_count").cast("long").alias("citation_count"),
    )
