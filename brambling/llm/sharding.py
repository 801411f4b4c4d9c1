"""Operator 4 (DataFrame functions only): a hierarchical weighted hash tree over shards.

The tree has regions of racks of shards. Every shard draws ``-ln(u) / weight`` from a hash of the
document and the shard; the draw of a rack or region is the least of its shards' draws, which is a
draw by the sum of their weights. A document descends by the least draw at each level, so a node gets
documents in proportion to its weight. A changed weight changes the draws of its own subtree only:
documents move into or out of that subtree and never between others, and a shard that is added takes
documents only into itself, whatever the number of shards.

The law is ``key``: doc_id and the number of shards decide. Slots follow the order of doc_id (null
first), checksum and size. Equal doc_ids go together, a null doc_id is a key like any other, null text
has size 1 (no bytes, plus 1), very long texts are only measured, repeated rows each get a slot (ties
between them change nothing), and an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS, RACKS_PER_REGION, SHARDS_PER_RACK = 8, 2, 2
#: Of equal rows, so many leave a task as one list.
REPEATS = 65_536


def _unit(name: Column) -> Column:
    """A number in (0, 1) from a name."""
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def draws(key: Column, shards: int, weights: dict[int, float] | None = None) -> Column:
    """The draw of every shard for a key; shards of no weight never win against others."""
    of = F.array(*[F.struct(F.lit(str(s)).alias("name"), F.lit(float((weights or {}).get(s, 1.0))).alias("weight")) for s in range(shards)])
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.transform(of, lambda s: F.when(s["weight"] > 0, -F.log(_unit(F.concat(text, F.lit("/"), s["name"]))) / s["weight"]).otherwise(float("inf")))


def descend(drawn: Column) -> Column:
    """The shard that a list of draws leads to, level by level."""

    def child(first: Column, children: int, width: int) -> Column:
        """Of nodes that cover ``width`` draws each, from ``first`` on, the one with the least."""
        least = F.transform(F.sequence(first, first + children - 1), lambda k: F.array_min(F.slice(drawn, k * width + 1, width)))
        return (first + F.array_position(least, F.array_min(least)) - 1).cast("int")

    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    regions = F.ceil(F.size(drawn) / per_region).cast("int")
    least = F.transform(F.sequence(F.lit(0), regions - 1), lambda k: F.array_min(F.slice(drawn, k * per_region + 1, per_region)))
    region = (F.array_position(least, F.array_min(least)) - 1).cast("int")
    return child(child(region * RACKS_PER_REGION, RACKS_PER_REGION, SHARDS_PER_RACK) * SHARDS_PER_RACK, SHARDS_PER_RACK, 1)


def assign(df: DataFrame, key: Column, shards: int, name: str, weights: dict[int, float] | None = None) -> DataFrame:
    """Adds the shard of every row as ``name``."""
    drawn = df.withColumn("_sh_draws", draws(key, shards, weights))
    return drawn.withColumn(name, descend(F.col("_sh_draws"))).drop("_sh_draws")


def _each(rows: DataFrame, n: str, first: str) -> DataFrame:
    """Every row ``n`` times, with slot from ``first`` on; many equal rows leave over several tasks."""
    few = rows.filter(F.col(n) <= REPEATS).withColumn("slot", F.explode(F.sequence(F.col(first), F.col(first) + F.col(n) - 1)))
    many = rows.filter(F.col(n) > REPEATS).withColumn("_sh_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / REPEATS))))
    low = F.col(first) + F.col("_sh_part") * REPEATS
    many = many.repartition(first, "_sh_part").withColumn("slot", F.explode(F.sequence(low, F.least(low + REPEATS, F.col(first) + F.col(n)) - 1)))
    return few.union(many.drop("_sh_part"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_sh_n"))
    # The first draws of the grown tree are those of the tree.
    drawn = rows.withColumn("_sh_draws", draws(F.col("doc_id"), shards + 1, weights))
    placed = written(drawn.select("doc_id", "size", "text_crc32", "_sh_n", descend(F.slice("_sh_draws", 1, shards)).alias("shard"), descend(F.col("_sh_draws")).alias("grown_shard")), "placed")

    order = ["doc_id", "text_crc32", "size"]
    ranges = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", *order)
    ranges = written(ranges.withColumn("_sh_range", F.spark_partition_id()), "ranges")
    # A row for every range, and one more for every shard that begins inside one.
    sizes = ranges.groupBy("shard", "_sh_range").agg(F.sum("_sh_n").alias("_sh_all"))
    sizes = sizes.select("shard", "_sh_range", (F.sum("_sh_all").over(Window.partitionBy("shard").orderBy("_sh_range")) - F.col("_sh_all")).alias("_sh_before"))
    within = Window.partitionBy("shard", "_sh_range").orderBy(*order)
    first = F.col("_sh_before") + F.sum("_sh_n").over(within) - F.col("_sh_n")
    rows = _each(ranges.join(sizes, ["shard", "_sh_range"]).withColumn("_sh_first", first), "_sh_n", "_sh_first")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
