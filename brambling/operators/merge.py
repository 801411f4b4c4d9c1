"""Upserts and guarded changes on immutable tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType


def latest_per_key(rows: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """Upsert that overwrites: the row of greatest sequence for every key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def newest_n(rows: DataFrame, keys: list[str], seq: str, n: int) -> DataFrame:
    """The n rows of greatest sequence for every key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def merge_filled(rows: DataFrame, key: str, seq: Column, filled: list[str], newest: list[str] = (), seen: str | tuple[str, str] | None = None) -> DataFrame:
    """Upsert that keeps what it has: of every ``filled`` column the newest value that isn't null or empty (text
    or list), of ``newest`` columns the newest of all, and the first and last of ``seen`` (or of two columns, the least of one and the greatest of the other)."""

    def last_filled(c: str) -> Column:
        listed = isinstance(rows.schema[c].dataType, ArrayType)
        there = (F.size(c) > 0) if listed else F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return F.max_by(F.when(there, F.col(c)), F.when(there, seq)).alias(c)

    out = [last_filled(c) for c in filled] + [F.max_by(c, seq).alias(c) for c in newest]
    if seen:
        low, high = (seen, seen) if isinstance(seen, str) else seen
        out += [F.min(low).alias("first_seen"), F.max(high).alias("last_seen")]
    return rows.groupBy(key).agg(*out)


def insert_missing(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert that ignores keys which are there already."""
    return base.unionByName(rows.dropDuplicates(keys).join(base, keys, "left_anti"), allowMissingColumns=True)


def fold_revisions(rows: DataFrame, deltas: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """Apply deltas in order, each only where its ``expected`` is the current ``revision``, which it raises.

    A row that is deleted (``deleted`` in a delta) takes no more. Rows (one for each key) and deltas are
    sorted by key and sequence, and a task holds the row it is at: keys of any number of deltas fit.
    """
    kinds = {f.name: f.dataType for f in deltas.schema}
    start = rows.select(key, F.lit(0).alias("_kind"), F.lit(None).cast(kinds[seq]).alias(seq), F.lit(None).cast(kinds["expected"]).alias("expected"), F.lit(False).alias("deleted"), *columns, F.col("revision").cast("long").alias("revision"))
    changes = deltas.select(key, F.lit(1).alias("_kind"), seq, "expected", "deleted", *columns, F.lit(None).cast("long").alias("revision"))
    out = rows.select(key, *columns, F.col("revision").cast("long").alias("revision"), F.lit(False).alias("deleted")).schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now = to_arrow_schema(out), None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["_kind"] == 0:
                    done += [now] if now else []
                    now = {c: r[c] for c in out.names}
                elif now and r[key] is not None and r[key] == now[key] and not now["deleted"] and r["expected"] == now["revision"]:
                    now = {c: now[c] if r[c] is None else r[c] for c in columns} | {key: now[key], "revision": now["revision"] + 1, "deleted": r["deleted"]}
            yield pa.RecordBatch.from_pylist(done, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now], schema)

    order = [key, "_kind", seq, "expected", "deleted", *columns]
    return start.unionByName(changes).repartition(key).sortWithinPartitions(*order).mapInArrow(fold, out)
