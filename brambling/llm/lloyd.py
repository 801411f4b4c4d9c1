"""Operator 12: product codes of vectors by delta-maintained Lloyd rounds.

Vectors of whole numbers are cut into equal consecutive parts, and every part position has a codebook. The
vectors are written once, bucketed by a row number; each round writes only the rows' new codes, bucketed alike,
so that the next round joins them without a shuffle. Sums and counts of the entries run on from round to
round: a part whose entry changed is added to the new one and taken from the old one, and nothing else is
shuffled. Tasks add those contributions up first, so a round moves at most a row for each entry and task. The
codebooks and their sums, a constant of ``parts * entries`` rows, are all that the driver holds.

All distances, sums and means are exact whole numbers; ties go to the lower entry.

Nulls and edges: a null or empty vector, and one with a null, non-finite or too large component
(``intvec.scaled``), take no part, nor do vectors of another length than the most frequent one that can be cut into equal
parts (the shorter of two such); a null id is coded like any other and comes last among the first entries; repeated
rows are coded each; with fewer rows than entries the codebook has as many entries as rows; an empty
table gives no rows; other columns, whatever their names, are ignored. There are no texts here.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, salted_join, table, tune, written
from .intvec import matrix, products, scaled

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BUCKET_ROWS = 500_000
CODED = "_row bigint, codes array<smallint>, error bigint, part int, entry int, n bigint, sums array<bigint>"


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row the nearest entry (ties to the lower) and its squared distance."""
    d = (book * book).sum(1) - 2 * products(x, book)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at] + (x * x).sum(1)


def _round(books: np.ndarray, first: bool):
    """Codes and error of every row, then the sums of what moved: plus for the new entry, minus for the old one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        names = ["_row", "codes", "error", "part", "entry", "n", "sums"]
        types = [pa.int64(), pa.list_(pa.int16()), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            x = matrix(batch.column("v"), parts * width).reshape(-1, parts, width)
            old = None if first else matrix(batch.column("codes"), parts)
            codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], d = nearest_entries(x[:, p], books[p])
                error += d
                moved = np.arange(len(x)) if first else np.flatnonzero(codes[:, p] != old[:, p])
                for sign, of in ((1, codes),) if first else ((1, codes), (-1, old)):
                    np.add.at(counts[p], of[moved, p], sign)
                    np.add.at(sums[p], of[moved, p], sign * x[moved, p])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, parts * (len(x) + 1), parts, dtype=np.int32)), pa.array(codes.ravel().astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), lists, pa.array(error), *[pa.nulls(len(x), t) for t in types[3:]]], names=names)
        at = [tuple(map(int, k)) for k in np.argwhere((counts != 0) | sums.any(2))]
        cols = [pa.nulls(len(at), t) for t in types[:3]] + [pa.array([p for p, _ in at], pa.int32()), pa.array([e for _, e in at], pa.int32()), pa.array([int(counts[k]) for k in at], pa.int64()), pa.array([sums[k].tolist() for k in at], types[-1])]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


class _Bucketed:
    """Tables in the shared folder, bucketed by _row into as many buckets each."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets

    def write(self, rows: DataFrame, *partitions: str) -> DataFrame:
        name = f"brambling_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").option("compression", "zstd").option("path", fresh_path(self.spark, "lloyd")).bucketBy(self.buckets, "_row")
        (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(name)
        return self.spark.table(name)


def _kept(vectors: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str, scale: int) -> tuple[DataFrame, int, int]:
    """Usable rows (vec_id, label, v), how many there are, and the length of their vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), scaled(F.col(vector_col), scale).alias("v")).filter("v is not null")
    lengths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).filter(F.col("width") % parts == 0)
    most = lengths.orderBy(F.desc("n"), "width").first()
    width, n = (most["width"], most["n"]) if most else (0, 0)
    return rows.filter(F.size("v") == width), n, width


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes, error of every usable row, and the final codebooks (parts x entries x width)."""
    spark = vectors.sparkSession
    tune(spark)
    rows, n, width = _kept(vectors, parts, id_col, vector_col, label_col, scale)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    if not first:
        return rows.select("vec_id", "label", F.array().cast("array<smallint>").alias("codes"), F.lit(0).cast("long").alias("error")), books
    store = _Bucketed(spark, max(8, -(-n // BUCKET_ROWS)))
    held = store.write(rows.withColumn("_row", F.monotonically_increasing_id()).repartition(store.buckets, "_row"))
    counts, sums, codes = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64), None
    for k in range(rounds + 1):
        source = held.select("_row", "v") if codes is None else held.select("_row", "v").join(codes, "_row")
        out = source.mapInArrow(_round(books, codes is None), CODED).withColumn("moved", F.col("part").isNotNull().cast("int"))
        out = store.write(out, "moved")
        codes = out.filter("moved = 0").select("_row", "codes")
        if k == rounds:
            break
        moved = out.filter("moved = 1").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(books.shape[2])]).alias("sums"))
        for r in moved.collect():  # at most parts * entries rows
            counts[r["part"], r["entry"]] += r["n"]
            sums[r["part"], r["entry"]] += np.array(r["sums"], np.int64)
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]
    last = out.filter("moved = 0").select("_row", "codes", "error")
    return held.select("_row", "vec_id", "label").join(last, "_row").drop("_row"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels (nulls together)."""
    coded = written(coded.withColumn("_ll_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))), "lloyd-coded")
    sums = written(coded.groupBy("_ll_key").agg(F.count("*").alias("_ll_n"), F.sum("error").alias("label_error")), "lloyd-labels")
    return salted_join(coded, sums, ["_ll_key"], "_ll_n", ["vec_id", "codes"]).drop("_ll_key", "_ll_n")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = product_codes(table(spark, sf_dir, "embeddings"))
    rows = with_label_error(coded)
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
