"""Small files in any store that Spark reads, through its own file systems: markers, manifests, locks."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create_new(spark: SparkSession, path: str, text: str = "") -> bool:
    """Writes a file that must not be there yet; False, and nothing written, where it is."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    if not fs.createNewFile(p):
        return False
    if text:
        out = fs.create(p, True)
        try:
            out.write(text.encode())
        finally:
            out.close()
    return True


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a file was written, by the clock of this machine; 0 where there is none."""
    fs, p = _at(spark, path)
    return max(0.0, time.time() - fs.getFileStatus(p).getModificationTime() / 1000) if fs.exists(p) else 0.0


def claim(spark: SparkSession, path: str, stale: float) -> bool:
    """Whether this process is the one that made a marker; one older than ``stale`` seconds is taken over, as its owner has died."""
    if age(spark, path) > stale:
        remove(spark, path)
    return create_new(spark, path)


def publish(spark: SparkSession, path: str, text: str, stale: float = 600) -> bool:
    """Writes a file that must not be there yet, so that readers never see a part of it: its name is claimed, the text is written
    beside and moved there. False, and nothing written, where it is there or another has just claimed it."""
    fs, p = _at(spark, path)
    if fs.exists(p) or not claim(spark, f"{path}.claim", stale):
        return False
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(aside, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
    return not fs.exists(p) and bool(fs.rename(aside, p))


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder, sorted; nothing where there is none."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p))
