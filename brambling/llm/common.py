"""What the operators share: reading tables, scratch tables in the shared folder, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS, ARROW_BYTES = "1000", str(32 << 20)
#: Keys of more rows than this are split over SALTS tasks, and known by one of PLACES numbers.
HOT_ROWS, SALTS, PLACES = 100_000, 32, 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and by bytes, as a batch of very long texts must still fit a Python
    worker. The two settings are the session's own and stay set: Spark reads them when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set and all runs on one machine."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "brambling-scratch")
    return root.rstrip("/")


def sample_by_hash(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """At most ``size`` rows, those of least hash of the keys; little more than that leaves the tasks."""
    share = min(1.0, 2 * size / max(rows.count(), 1) + 1e-9)
    hashed = rows.withColumn("_sample", F.xxhash64(*keys, F.lit(7)))
    least = F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    return hashed.filter(F.col("_sample") <= least).orderBy("_sample").limit(size).drop("_sample")


def salted_join(rows: DataFrame, unique: DataFrame, keys: list[str], n: str, spread: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``unique``, which holds every key once and in column ``n`` how many rows it has.

    Rows of a frequent key are dealt by ``spread`` over several tasks, to each of which the key's one
    row is copied. Which keys are frequent travels as at most PLACES broadcast numbers. ``unique`` is
    read twice: have it written.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(PLACES)).cast("int")
    hot = F.broadcast(unique.filter(F.col(n) > HOT_ROWS).select(place.alias("_hot")).distinct())
    a = rows.join(hot, place == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))).drop("_hot")
    b = unique.join(hot, place == F.col("_hot"), "left").withColumn("_salt", F.explode(F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1))))).drop("_hot")
    return a.join(b, [*keys, "_salt"]).drop("_salt")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, and what
    a lost executor had is read again instead of computed again."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
