"""Record shapes of further harvest sources, DOCX files, and runs over several sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.functions import clean_doi, last_segment

_text = lambda c: F.coalesce(F.col(c), F.lit(""))
_filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
_names = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def _records(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*[c.alias(name) for name, c in columns.items()])


def normalise_semantic_scholar(items: DataFrame) -> DataFrame:
    """paperId, externalIds {DOI, ArXiv}, title, abstract, authors [{name}], publicationDate, url, openAccessPdf {url},
    publicationTypes [], citationCount. Empty author names stay."""
    pdf = F.coalesce(F.col("openAccessPdf.url"), F.lit(""))
    return _records(
        items, source_id=F.col("paperId"), doi=clean_doi(F.col("externalIds.DOI")), arxiv_id=F.coalesce("externalIds.ArXiv", F.lit("")),
        title=_text("title"), abstract=_text("abstract"), authors=F.coalesce(F.transform("authors", lambda a: F.coalesce(a["name"], F.lit(""))), F.array().cast("array<string>")),
        published=_text("publicationDate"), landing_url=_text("url"), oa_status=F.when(pdf != "", "open").otherwise("unknown"), oa_url=pdf,
        work_type=F.array_join(_names("publicationTypes"), ","), updated=F.lit(""), citation_count=F.col("citationCount").cast("long"),
    )


def normalise_core(items: DataFrame) -> DataFrame:
    """id, doi, arxivId, title, abstract, authors [], publishedDate, sourceFulltextUrls [], downloadUrl, type, updatedDate."""
    sources = F.coalesce(F.size("sourceFulltextUrls"), F.lit(0)) > 0
    return _records(
        items, source_id=F.coalesce(F.col("id").cast("string"), F.lit("")), doi=clean_doi(F.col("doi")), arxiv_id=_text("arxivId"),
        title=_text("title"), abstract=_text("abstract"), authors=_names("authors"), published=_text("publishedDate"),
        landing_url=F.when(sources, F.get("sourceFulltextUrls", F.lit(0))).otherwise(_text("downloadUrl")),
        oa_status=F.when(_filled("downloadUrl") | sources, "open").otherwise("unknown"), oa_url=_text("downloadUrl"),
        work_type=_text("type"), updated=_text("updatedDate"), citation_count=F.lit(None).cast("long"),
    )


def normalise_europe_pmc(items: DataFrame) -> DataFrame:
    """id, source, doi, pmcid, title, abstractText, authorString, firstPublicationDate, pubYear, isOpenAccess, pubType,
    lastUpdateDate, citedByCount. No authors give one empty name."""
    free = F.coalesce(F.col("isOpenAccess") == "Y", F.lit(False))
    landing = F.concat(F.lit("https://europepmc.org/article/"), F.coalesce("source", F.lit("MED")), F.lit("/"), _text("id"))
    return _records(
        items, source_id=_text("id"), doi=clean_doi(F.col("doi")), arxiv_id=F.lit(""), title=_text("title"), abstract=_text("abstractText"),
        authors=F.split(_text("authorString"), ", "), published=F.when(_filled("firstPublicationDate"), F.col("firstPublicationDate")).otherwise(_text("pubYear")),
        landing_url=landing, oa_status=F.when(free, "open").otherwise("closed_or_unknown"),
        oa_url=F.when(free & _filled("pmcid"), F.concat(F.lit("https://europepmc.org/articles/"), "pmcid")).otherwise(""),
        work_type=_text("pubType"), updated=_text("lastUpdateDate"), citation_count=F.col("citedByCount").cast("long"),
    )


ENTRY = "id string, title string, summary string, author array<struct<name: string>>, published string, updated string"


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """The entries of Atom files."""
    return spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)


def normalise_arxiv(entries: DataFrame) -> DataFrame:
    """Entries as ``read_atom`` gives them; the identifier keeps its version."""
    number = last_segment(F.rtrim(_text("id"), F.lit("/")))
    return _records(
        entries, source_id=number, doi=F.lit(""), arxiv_id=number, title=_one_line(F.col("title")), abstract=_one_line(F.col("summary")),
        authors=F.coalesce(F.transform("author", lambda a: F.coalesce(a["name"], F.lit(""))), F.array().cast("array<string>")),
        published=_text("published"), landing_url=_text("id"), oa_status=F.lit("open"), oa_url=F.lit(""), work_type=F.lit("preprint"),
        updated=_text("updated"), citation_count=F.lit(None).cast("long"),
    )


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_text(content: bytes) -> str | None:
    """The paragraphs of a DOCX file, one a line; None where it can't be read."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))


def docx_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of every DOCX file under a folder; unreadable ones are left out."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "content": pdf["content"].map(_docx_text)}).dropna(subset=["content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder)
    return files.select("path", "content").mapInPandas(read, "path string, content string")


def file_tree(paths: DataFrame, kinds: tuple[str, ...] = (".txt", ".md", ".pdf", ".docx")) -> DataFrame:
    """path, name, depth, is_dir of all folders above the files of a ``path`` column, and of files whose names are of the known kinds."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    known = F.regexp_like(F.lower(F.element_at(parts, -1)), F.lit("(" + "|".join(k.replace(".", "\\.") for k in kinds) + ")$"))
    rows = paths.filter(F.size(parts) > 0).select(parts.alias("parts"), known.alias("known")).select("parts", "known", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    rows = rows.withColumn("is_dir", F.col("depth") < F.size("parts")).filter("is_dir or known")
    return rows.select(F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"), F.element_at("parts", F.col("depth")).alias("name"), "depth", "is_dir").distinct()


def harvest(readers: dict[str, Callable[[], DataFrame]], staging: str) -> tuple[DataFrame | None, list[dict]]:
    """Every source in order, each written as a whole before it counts: one that fails leaves nothing and stops no other.

    Gives the records of those that came (with ``source`` and ``place``, the source's number) and a report of all.
    """
    report, found = [], None
    for place, (name, read) in enumerate(readers.items()):
        path = f"{staging}/{name}"
        try:
            records = read().withColumns({"source": F.lit(name), "place": F.lit(place)})
            records.write.mode("overwrite").parquet(path)
        except Exception as e:  # noqa: BLE001  whatever a source does wrong is its own
            report.append({"source": name, "status": "failed", "error": str(e).splitlines()[0] if str(e) else type(e).__name__, "received": 0})
            continue
        rows = records.sparkSession.read.parquet(path)
        report.append({"source": name, "status": "ok", "error": "", "received": rows.count()})
        found = rows if found is None else found.unionByName(rows)
    return found, report
