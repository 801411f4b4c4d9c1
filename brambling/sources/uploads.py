"""A sink for uploaded files as a data source: format ``uploads``.

    rows.write.format("uploads").mode("append").option("path", home).option("by", "u1").save()

Rows: collection, name, content (binary). Tasks write each file under a folder of the job's own, with a prefix of eight
hexadecimal digits before its name, and a list of them beside; when all have ended the driver names the lists in one manifest, and
only then are the files there. A job that fails takes its folders away; what a lost driver leaves behind is named by no manifest, and ``sweep`` takes it away. A name
that is none (empty, ".", "..") or has another ending than the allowed ones fails the job, as one bad upload
may not come in beside good ones by chance. Files are written through Arrow's file systems, so that the
home may be any that they know (file, hdfs, s3, gs), shared by driver and executors.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# What may be uploaded, and where to.
ALLOWED = (".txt", ".md", ".pdf", ".docx")
COLLECTIONS = ("public", "private", "novel", "data")
MANIFEST = "collection string, name string, stored string, bytes long, sha256 string, uploaded_by string, job string"


def file_system(uri: str) -> tuple[object, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)


def bare_name(name: str | None) -> str:
    """The last part of a name; an error where it is none or its ending isn't allowed."""
    last = (name or "").replace("\\", "/").rsplit("/", 1)[-1]
    if last in ("", ".", "..") or not last.lower().endswith(ALLOWED):
        raise ValueError(f"not an allowed file name: {name!r} (allowed endings: {', '.join(ALLOWED)})")
    return last


def stored_name(job: str, collection: str, name: str, content: bytes, nth: int) -> str:
    """The prefix is a digest of the job and the file, so a task that runs again writes the same files."""
    return hashlib.sha256(b"\0".join([job.encode(), collection.encode(), str(nth).encode(), content])).hexdigest()[:8] + "_" + name


@dataclass
class _Written(WriterCommitMessage):
    part: str | None  # where a task's files are listed


class UploadWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.home, self.by, self.job, self.names = options["path"].rstrip("/"), options.get("by", ""), uuid.uuid4().hex, names
        if missing := {"collection", "name", "content"} - set(names):
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, home = file_system(self.home)
        files, seen = [], set()
        for nth, r in enumerate(rows):
            if r["collection"] not in COLLECTIONS:
                raise ValueError(f"unknown collection: {r['collection']!r}")
            name, content = bare_name(r["name"]), bytes(r["content"] or b"")
            # Each attempt has a folder of its own: one that is cut off can't be taken for another's.
            folder = f"batches/{self.job}/{context.partitionId()}-{context.taskAttemptId()}/{r['collection']}"
            stored = f"{folder}/{stored_name(self.job, r['collection'], name, content, nth)}"
            if folder not in seen:
                fs.create_dir(f"{home}/{folder}", recursive=True)
                seen.add(folder)
            with fs.open_output_stream(f"{home}/{stored}") as out:
                out.write(content)
            files.append({"collection": r["collection"], "name": name, "stored": stored, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "uploaded_by": self.by, "job": self.job})
        if not files:
            return _Written(None)
        part = f"parts/{self.job}/{context.partitionId()}-{context.taskAttemptId()}.json"
        fs.create_dir(f"{home}/parts/{self.job}", recursive=True)
        with fs.open_output_stream(f"{home}/{part}") as out:
            for f in files:
                out.write((json.dumps(f, ensure_ascii=False) + "\n").encode())
        return _Written(part)

    def commit(self, messages: list) -> None:
        """One manifest names the lists of all tasks; it is written beside its place and then moved there."""
        fs, home = file_system(self.home)
        fs.create_dir(f"{home}/manifests", recursive=True)
        with fs.open_output_stream(f"{home}/manifests/_{self.job}") as out:
            for m in messages:
                if m and m.part:
                    out.write((json.dumps({"part": m.part}) + "\n").encode())
        fs.move(f"{home}/manifests/_{self.job}", f"{home}/manifests/{self.job}.json")

    def abort(self, messages: list) -> None:
        """Tasks that are still at work may write for a moment longer: what is left then ``sweep`` takes away."""
        for _ in range(5):
            if _delete(self.home, self.job):
                return
            time.sleep(0.2)


def _delete(home: str, job: str) -> bool:
    """Whether a job's folders are gone."""
    from pyarrow.fs import FileType

    fs, path = file_system(home)
    folders = [f"{path}/parts/{job}", f"{path}/batches/{job}"]
    try:
        for folder in folders:
            if fs.get_file_info(folder).type == FileType.Directory:
                fs.delete_dir(folder)
    except OSError:  # a file came while the folder was being deleted
        return False
    return all(fs.get_file_info(folder).type == FileType.NotFound for folder in folders)


def unnamed(home: str) -> dict[str, float]:
    """Jobs that have folders and that no manifest names, with the time of their newest folder."""
    from pyarrow.fs import FileSelector

    fs, path = file_system(home)
    below = lambda folder: fs.get_file_info(FileSelector(f"{path}/{folder}", allow_not_found=True))
    named, jobs = {x.base_name.removesuffix(".json") for x in below("manifests")}, {}
    for x in [*below("batches"), *below("parts")]:
        if x.base_name not in named and x.mtime is not None:
            jobs[x.base_name] = max(jobs.get(x.base_name, 0.0), x.mtime.timestamp())
    return jobs


def sweep(home: str, older: float = 86_400) -> list[str]:
    """Takes away the folders of jobs that no manifest names, changed last more than ``older`` seconds ago; gives the jobs."""
    return [job for job, at in unnamed(home).items() if time.time() - at >= older and _delete(home, job)]


class UploadSink(DataSource):
    """Options: path (the home), by (who uploads)."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def writer(self, schema, overwrite: bool) -> UploadWriter:
        if overwrite:
            raise ValueError("uploads are appended only")
        return UploadWriter(dict(self.options), schema.names)


def upload(files: DataFrame, home: str, by: str = "") -> None:
    """Store files (collection, name, content) with their provenance; all of them or none."""
    files.sparkSession.dataSource.register(UploadSink)
    files.select("collection", "name", F.col("content").cast("binary").alias("content")).write.format("uploads").mode("append").option("path", home).option("by", by).save()


def manifest(spark: SparkSession, home: str) -> DataFrame:
    """collection, name, stored, bytes, sha256, uploaded_by, job of every file that was uploaded; none where nothing was."""
    from pyarrow.fs import FileType

    fs, path = file_system(home)
    there = fs.get_file_info(f"{path}/manifests").type == FileType.Directory
    parts = [r["part"] for r in spark.read.schema("part string").option("pathGlobFilter", "*.json").json(f"{home}/manifests").collect()] if there else []  # a row for each task
    return spark.read.schema(MANIFEST).json([f"{home}/{p}" for p in parts]) if parts else spark.createDataFrame([], MANIFEST)


#: Bytes of files that a task holds before it gives them on.
READ_BYTES = 16 << 20


def uploaded(spark: SparkSession, home: str) -> DataFrame:
    """The manifest's files with their content; null where a file is gone. Each is read where its row of the manifest is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(home)
        for batch in batches:
            held, size, start = [], 0, 0
            for n, stored in enumerate(batch.column("stored").to_pylist(), 1):
                try:
                    with fs.open_input_stream(f"{path}/{stored}") as file:
                        held.append(file.read())
                except FileNotFoundError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= READ_BYTES or n == len(batch):
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(held)).columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])
                    held, size, start = [], 0, n

    return manifest(spark, home).mapInArrow(run, f"{MANIFEST}, content binary")
